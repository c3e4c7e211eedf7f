"""Files to lines, spans and fragments.

Nothing here looks at more than one file at a time, and a file is bounded by its
size limit. When no spans are given, cutting is a narrow projection without shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import text as X

FILE_KEY = ["job_id", "file"]
PYTHON_HEAD = r"^\s*(?:async\s+)?def\s+([\p{L}_][\p{L}\p{N}_]*)"
NOT_A_FUNCTION = r"(?!(?:if|else|for|while|switch|do|return|catch|try|new|throw)\b)"
BRACE_HEAD = (
    r"^\s*+" + NOT_A_FUNCTION + r"[\w<>\[\],.&*\s]*?\b" + NOT_A_FUNCTION
    + r"([A-Za-z_$][\w$]*)\s*\([^;]*(?:\{.*)?$"
)


def split_lines(files: DataFrame) -> DataFrame:
    """One row per line: (job_id, file, n, text), numbered from 1."""
    return files.select(
        *FILE_KEY, F.posexplode(X.split_lines("content")).alias("pos", "text")
    ).select(*FILE_KEY, (F.col("pos") + 1).alias("n"), "text")


def _cut(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end; one empty line at the very end is not part of a unit."""
    part = F.slice(lines, start, end - start + 1)
    return X.let(
        part,
        lambda v: F.when(F.try_element_at(v, F.lit(-1)) == "", F.slice(v, 1, F.size(v) - 1)).otherwise(v),
    )


def dedupe_spans(spans: DataFrame) -> DataFrame:
    """One span per (file, start, end): the first by ``ordinal`` where the spans have one, else by name."""
    name = F.min_by("name", F.struct("ordinal", "name")) if "ordinal" in spans.columns else F.min("name")
    return spans.groupBy(*FILE_KEY, "start_line", "end_line").agg(name.alias("name"))


def attach_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """The code of each span, cut out of its file."""
    return (
        files.withColumn("lines", X.split_lines("content"))
        .drop("content")
        .join(spans.select(*FILE_KEY, "start_line", "end_line", "name"), FILE_KEY)
        .withColumn("code", F.array_join(
            F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
        .drop("lines")
    )


def uncovered_blocks(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Maximal runs of lines outside all spans: (job_id, file, start_line, end_line).

    Worked out from the span boundaries alone: a block lies between the furthest end
    so far and the next start. Runs of blank lines are not blocks.
    """
    sizes = files.select(*FILE_KEY, X.split_lines("content").alias("lines"))
    sizes = sizes.withColumn("n_lines", F.size("lines"))
    stops = sizes.select(*FILE_KEY, (F.col("n_lines") + 1).alias("start_line"),
                         (F.col("n_lines") + 1).alias("end_line"))
    w = Window.partitionBy(*FILE_KEY).orderBy("start_line", "end_line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    gaps = (
        spans.select(*FILE_KEY, "start_line", "end_line")
        .unionByName(stops)
        .withColumn("gap_start", F.coalesce(F.max("end_line").over(before), F.lit(0)) + 1)
        .withColumn("gap_end", F.col("start_line") - 1)
        .filter("gap_end >= gap_start")
    )
    has_text = F.exists(
        F.slice("lines", F.col("gap_start"), F.col("gap_end") - F.col("gap_start") + 1),
        lambda x: F.rlike(x, F.lit("[^" + C.SPACE_CLASS + "]")),
    )
    return (
        gaps.join(sizes, FILE_KEY)
        .filter(has_text)
        .select(*FILE_KEY, F.col("gap_start").alias("start_line"), F.col("gap_end").alias("end_line"))
    )


def sliding_windows(units: DataFrame, size: int = C.WINDOW_LINES, stride: int = C.WINDOW_STRIDE) -> DataFrame:
    """Replace ``unit_lines`` (starting at ``start_line``) by overlapping windows."""
    n = F.size("unit_lines")
    last = (F.ceil(F.greatest(n - size, F.lit(0)) / stride) * stride).cast("int")
    chunk = F.slice("unit_lines", F.col("offset") + 1, F.lit(size))
    return (
        units.withColumn("offset", F.explode(F.sequence(F.lit(0), last, F.lit(stride))))
        .withColumn("chunk", chunk)
        .withColumn("start_line", F.col("start_line") + F.col("offset"))
        .withColumn("end_line", F.least(F.col("start_line") + size - 1, F.col("start_line") + n - F.col("offset") - 1))
        .withColumn("code", F.array_join("chunk", "\n"))
        .drop("offset", "chunk", "unit_lines")
    )


def fragments(files: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Fragments that together cover every non-blank line of every file.

    ``spans`` lists function ranges; lines outside them form further units. All units
    are cut into windows, and equal ranges of one file are one fragment.
    """
    keep = [*FILE_KEY, "file_ord", "language"]
    lines = once(files.select(*keep, "content"), "lines", X.split_lines("content")).drop("content")
    if spans is None:
        units = lines.select(
            *keep,
            F.lit(1).alias("start_line"),
            F.explode(F.array(_cut(F.col("lines"), F.lit(1), F.size("lines")))).alias("unit_lines"),
            F.lit("").alias("name"),
        ).filter(F.exists("unit_lines", lambda x: F.rlike(x, F.lit("[^" + C.SPACE_CLASS + "]"))))
        return _with_id(sliding_windows(units))
    ranges = (
        dedupe_spans(spans)
        .withColumn("rank", F.col("end_line") - F.col("start_line"))
        .unionByName(
            uncovered_blocks(files, spans).select(
                "*", F.lit("").alias("name"), F.lit(-1).alias("rank"))
        )
    )
    units = lines.join(ranges, FILE_KEY).select(
        *keep, "start_line", "name", "rank",
        _cut(F.col("lines"), F.col("start_line"), F.col("end_line")).alias("unit_lines"),
    ).filter(F.size("unit_lines") > 0)
    windows = sliding_windows(units)
    return _with_id(
        windows.groupBy(*FILE_KEY, "start_line", "end_line")
        .agg(
            F.first("file_ord").alias("file_ord"),
            F.first("language").alias("language"),
            F.min_by("name", F.struct("rank", "name")).alias("name"),
            F.first("code").alias("code"),
        )
    )


def _with_id(frags: DataFrame) -> DataFrame:
    return frags.select(
        "job_id",
        F.concat_ws("#", "file", "start_line", "end_line").alias("frag_id"),
        "file", "file_ord", "language",
        F.col("start_line").cast("int").alias("start_line"),
        F.col("end_line").cast("int").alias("end_line"),
        "name", "code",
    )


def with_tokens(frags: DataFrame, python_lexer: bool = True) -> DataFrame:
    """Add ``tokens``: the Python lexer for Python code, the token grammar for the rest."""
    if not python_lexer:
        return once(frags, "tokens", X.tokens("code"))
    from twinspan.functions.python_tokens import python_tokens

    # The condition is the argument: a guard around the call would not keep other code out of it.
    lexed = python_tokens(F.when(F.col("language") == "python", F.col("code")))
    return once(
        frags.withColumn("_lexed", lexed), "tokens", F.coalesce("_lexed", X.tokens("code"))
    ).drop("_lexed")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections cannot recompute.

    A filter on a plain computed column is pushed below the projection together with
    a copy of the computation. The one-row generator keeps an expensive value in one
    place.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def usable_fragments(frags: DataFrame) -> DataFrame:
    return frags.filter(X.usable("tokens"))


def fragment_guard(frags: DataFrame, max_per_job: int | None) -> DataFrame:
    """Fail when a job has more fragments than allowed. No limit by default."""
    if max_per_job is None:
        return frags
    from twinspan.functions.numeric import require

    # One figure for the whole table; the fragments themselves don't move.
    largest = frags.groupBy("job_id").agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    return frags.filter(require(F.coalesce(largest, F.lit(0)) <= max_per_job, f"a job has more than {max_per_job} fragments"))


def fragment_totals(frags_with_tokens: DataFrame) -> DataFrame:
    """Per job: fragments before and after the usability filter."""
    return frags_with_tokens.groupBy("job_id").agg(
        F.count("*").alias("fragments"),
        F.count_if(X.usable("tokens")).alias("usable"),
    )


def split_encodable(
    frags: DataFrame, max_tokens: int | None = None, max_chars: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(usable, exclusions with reason). Nothing is truncated; no limit unless one is given."""
    reason = F.when(F.length("code") < 1, "empty code")
    if max_chars is not None:
        reason = reason.when(F.length("code") > max_chars, f"more than {max_chars} characters")
    if max_tokens is not None:
        reason = reason.when(F.size("tokens") > max_tokens, f"more than {max_tokens} tokens")
    marked = frags.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


# --- spans found in the text itself ------------------------------------------


def indent_blocks(lines: DataFrame, head: str = PYTHON_HEAD, decorator: str = r"^\s*@") -> DataFrame:
    """Blocks opened by a ``head`` line and held together by deeper indentation.

    A block ends before the next line indented no deeper than its head; lines that
    only close a bracket do not end it. Decorator lines above belong to the block.

    Each line is repeated once per indentation level it can close. Levels come from
    the heads of its file, so the repetition is the nesting depth, and the closing
    line is the next row of the same level: no join of heads with lines.
    """
    w = Window.partitionBy(*FILE_KEY).orderBy("n")
    blank = ~F.rlike("text", F.lit("[^" + C.SPACE_CLASS + "]"))
    rows = (
        lines.filter(~blank)
        .withColumn("indent", F.length(F.regexp_extract(F.regexp_replace("text", "\t", "        "), "^( *)", 1)))
        .withColumn("is_head", F.rlike("text", F.lit(head)))
        .withColumn("prev", F.lag("n").over(w))
        .withColumn("deco", F.rlike("text", F.lit(decorator)))
        .withColumn("deco_run", F.sum(F.when(F.col("deco"), 0).otherwise(1)).over(w))
        .withColumn("closing", ~F.rlike("text", F.lit(r"^\s*[)\]}]")))
    )
    runs = Window.partitionBy(*FILE_KEY, "deco_run")
    rows = rows.withColumn("run_start", F.min(F.when(F.col("deco"), F.col("n"))).over(runs))
    rows = rows.withColumn(
        "start_line",
        F.when(F.lag("deco").over(w), F.lag("run_start").over(w)).otherwise(F.col("n")),
    )
    per_file = rows.groupBy(*FILE_KEY).agg(
        F.collect_set(F.when(F.col("is_head"), F.col("indent"))).alias("levels"),
        F.max("n").alias("last"),
    )
    level = Window.partitionBy(*FILE_KEY, "level").orderBy("n")
    return (
        rows.filter("closing OR is_head")
        .join(per_file, FILE_KEY)
        .withColumn("level", F.explode(F.filter("levels", lambda v: v >= F.col("indent"))))
        .withColumn("end_line", F.coalesce(F.lead("prev").over(level), F.col("last")))
        .filter("is_head AND level = indent")
        .select(
            *FILE_KEY, "start_line", "end_line",
            F.regexp_extract("text", head, 1).alias("name"),
        )
    )


def mask_code(content: Column | str) -> Column:
    """Blank out comments and string literals, keeping the line structure."""
    parts = F.regexp_extract_all(X.col(content), F.lit(C.CODE_SEGMENT_PATTERN), F.lit(0))
    hidden = lambda p: p.startswith("//") | p.startswith("/*") | F.rlike(p, F.lit("""^['"].""" ))
    return F.array_join(
        F.transform(parts, lambda p: F.when(hidden(p), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)),
        "",
    )


def brace_depth(lines: DataFrame) -> DataFrame:
    """Add ``opens``, ``depth_before`` and ``depth_after`` by a running sum of braces."""
    w = Window.partitionBy(*FILE_KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.length("text") - F.length(F.translate("text", "{", ""))
    closes = F.length("text") - F.length(F.translate("text", "}", ""))
    return (
        lines.withColumn("opens", opens)
        .withColumn("delta", opens - closes)
        .withColumn("depth_after", F.sum("delta").over(w))
        .withColumn("depth_before", F.col("depth_after") - F.col("delta"))
        .drop("delta")
    )


def brace_blocks(lines: DataFrame, head: str = BRACE_HEAD) -> DataFrame:
    """Blocks opened by a ``head`` line and closed by the matching brace.

    ``lines`` should come from masked code. The body opens at the first brace at or
    after the head and ends at the first line back at the depth of the head.
    """
    # "The next one" is the last one seen from the end: a frame that only grows is kept up
    # row by row, one that reaches to the end would be read anew for each row.
    after = Window.partitionBy(*FILE_KEY).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        brace_depth(lines)
        .withColumn("is_head", F.rlike("text", F.lit(head)))
        .withColumn("opened", F.last(F.when(F.col("opens") > 0, F.col("n")), ignorenulls=True).over(after))
    )
    heads = rows.filter("is_head AND opened IS NOT NULL").select(
        *FILE_KEY, F.col("depth_before").alias("level"), F.col("opened").alias("at"),
        F.col("n").alias("start_line"), F.regexp_extract("text", head, 1).alias("name"),
        F.lit(0).alias("kind"),
    )
    levels = heads.groupBy(*FILE_KEY).agg(F.collect_set("level").alias("levels"))
    closers = (
        rows.join(levels, FILE_KEY)
        .withColumn("level", F.explode(F.filter("levels", lambda v: v >= F.col("depth_after"))))
        .select(*FILE_KEY, "level", F.col("n").alias("at"), F.lit(None).cast("int").alias("start_line"),
                F.lit("").alias("name"), F.lit(1).alias("kind"))
    )
    w = Window.partitionBy(*FILE_KEY, "level").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        heads.unionByName(closers)
        .withColumn("end_line", F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(w))
        .filter("kind = 0 AND end_line IS NOT NULL")
        .select(*FILE_KEY, "start_line", "end_line", "name")
    )


def mark_clone_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Flag lines inside any cloned region (job_id, file, start_line, end_line).

    Regions become +1/-1 steps summed along the file, so a line met by many regions
    is not multiplied by them.
    """
    steps = regions.select(*FILE_KEY, F.col("start_line").alias("n"), F.lit(1).alias("d")).unionByName(
        regions.select(*FILE_KEY, (F.col("end_line") + 1).alias("n"), F.lit(-1).alias("d"))
    ).groupBy(*FILE_KEY, "n").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*FILE_KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.join(steps, [*FILE_KEY, "n"], "left")
        .withColumn("in_clone", F.coalesce(F.sum("d").over(w), F.lit(0)) > 0)
        .drop("d")
    )
