"""Text, path and token expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinspan import constants as C

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A lambda variable is bound, not inlined, so an expensive array is not rebuilt
    for each element of an inner loop.
    """
    return F.transform(F.array(value), body)[0]


# --- paths and files --------------------------------------------------------


def normalise_path(path: ColumnLike) -> Column:
    """Forward slashes, no leading slash."""
    return F.regexp_replace(F.translate(col(path), "\\", "/"), "^/+", "")


def extension(path: ColumnLike) -> Column:
    """Lower-case text after the last dot; null when there is no dot."""
    p = col(path)
    return F.when(F.instr(p, ".") > 0, F.lower(F.substring_index(p, ".", -1)))


def detect_language(path: ColumnLike) -> Column:
    """Language by extension, null when the file is not supported."""
    pairs = [F.lit(v) for kv in C.LANGUAGE_BY_EXTENSION.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def is_supported(path: ColumnLike) -> Column:
    return F.coalesce(extension(path).isin(*C.SUPPORTED_EXTENSIONS), F.lit(False))


def path_parts(path: ColumnLike) -> Column:
    """struct(name, dir, ext): ``ext`` is upper-case, the name itself without a dot."""
    p = F.translate(col(path), "\\", "/")
    name = F.substring_index(p, "/", -1)
    return F.struct(
        name.alias("name"),
        F.regexp_extract(p, "^(.*/)?[^/]*$", 1).alias("dir"),
        F.upper(F.substring_index(name, ".", -1)).alias("ext"),
    )


def decode_source(data: ColumnLike, universal_newlines: bool = False) -> Column:
    """Bytes as UTF-8 with replacement of bad sequences."""
    text = F.make_valid_utf8(col(data).cast("string"))
    return F.regexp_replace(text, "\r\n?", "\n") if universal_newlines else text


def size_kb(content: ColumnLike) -> Column:
    return F.round(F.octet_length(col(content)) / F.lit(1024), 2)


def size_label(n_bytes: ColumnLike) -> Column:
    """``512 B`` or ``1.5 KB``."""
    n = col(n_bytes)
    return F.when(
        n > 1024, F.format_string("%.1f KB", n / 1024)
    ).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def truncate_error(message: ColumnLike) -> Column:
    return F.substring(col(message), 1, C.ERROR_LIMIT)


def walk_key(path: ColumnLike) -> Column:
    """Sort key of a top-down walk: a folder's own files precede its sub-folders."""
    parts = F.split(col(path), "/", -1)
    return F.transform(
        parts,
        lambda p, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), p),
    )


# --- lines ------------------------------------------------------------------


def split_lines(content: ColumnLike) -> Column:
    """Array of lines; a final line break does not open another line."""
    return let(
        F.split(col(content), C.LINE_BREAK, -1),
        lambda v: F.when(
            F.element_at(v, -1) == "", F.slice(v, 1, F.size(v) - 1)
        ).otherwise(v),
    )


def nonblank_line_count(code: ColumnLike) -> Column:
    return F.size(F.filter(split_lines(code), lambda x: F.rlike(x, F.lit(f"[^{C.SPACE_CLASS}]"))))


def line_range(start: ColumnLike, end: ColumnLike) -> Column:
    return F.sequence(col(start), col(end))


def overlaps(file_a, start_a, end_a, file_b, start_b, end_b) -> Column:
    """Do two line ranges of one file share a line?"""
    return (
        (col(file_a) == col(file_b))
        & (col(end_a) >= col(start_b))
        & (col(end_b) >= col(start_a))
    )


# --- tokens -----------------------------------------------------------------


def normalise_text(code: ColumnLike) -> Column:
    space = "[" + C.SPACE_CLASS + "]"
    trimmed = F.regexp_replace(col(code), f"^{space}+|{space}+$", "")
    return F.regexp_replace(F.lower(trimmed), f"{space}+", " ")


def tokens(code: ColumnLike) -> Column:
    """Identifiers, literals, operators and other signs, without comments."""
    found = F.regexp_extract_all(col(code), F.lit(C.TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~(t.startswith("//") | t.startswith("/*")))


def is_keyword(token: Column) -> Column:
    return token.isin(*C.KEYWORDS)


def is_literal(token: Column) -> Column:
    return F.rlike(token, F.lit(C.LITERAL_PATTERN))


def looks_like_identifier(token: Column) -> Column:
    """Lexical identifier test; words and layout markers count too."""
    return F.rlike(token, F.lit(C.IDENTIFIER_STRICT_PATTERN))


def near_miss_tokens(toks: ColumnLike, params: ColumnLike) -> Column:
    """Parameterised tokens with the literal values put back."""
    return F.zip_with(
        col(toks), col(params), lambda t, p: F.when(p == "LITERAL", t).otherwise(p)
    )


def token_weight(token: Column) -> Column:
    """Ten times the near-miss weight, an exact integer."""
    return (
        F.when(token.isin(*C.DELIMITERS), F.lit(C.DELIMITER_WEIGHT))
        .when(token.startswith("ID_"), F.lit(C.IDENTIFIER_WEIGHT))
        .otherwise(F.lit(C.OTHER_WEIGHT))
    )


def token_codes(toks: ColumnLike) -> Column:
    """Tokens as integers: a hash whose last two bits are the weight class."""
    kind = lambda t: (
        F.when(t.isin(*C.DELIMITERS), F.lit(0)).when(t.startswith("ID_"), F.lit(1)).otherwise(F.lit(2))
    )
    return F.transform(
        col(toks), lambda t: F.shiftleft(F.xxhash64(t), 2).bitwiseOR(kind(t).cast("bigint"))
    )


def total_weight(toks: ColumnLike) -> Column:
    return F.aggregate(
        col(toks), F.lit(0).cast("bigint"), lambda acc, t: acc + token_weight(t)
    )


def fingerprint(toks: ColumnLike) -> Column:
    return F.sha2(F.to_json(col(toks)), 256)


def usable(toks: ColumnLike) -> Column:
    """Enough tokens, a name among them, and not just the opening of a type."""
    t = col(toks)
    last = F.try_element_at(F.filter(t, lambda x: x != "NEWLINE"), F.lit(-1))
    opens_type = F.coalesce(last.isin("{", ":"), F.lit(False)) & F.arrays_overlap(
        t, F.array(*[F.lit(w) for w in C.DECLARATION_WORDS])
    )
    return (F.size(t) >= C.MIN_TOKENS) & F.exists(t, looks_like_identifier) & ~opens_type


def strip_comments(code: ColumnLike) -> Column:
    """C-family comments become one space and blank lines go; strings are kept."""
    parts = F.regexp_extract_all(col(code), F.lit(C.CODE_SEGMENT_PATTERN), F.lit(0))
    joined = F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p.startswith("//") | p.startswith("/*"), F.lit(" ")).otherwise(p),
        ),
        "",
    )
    kept = F.filter(F.split(joined, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{C.SPACE_CLASS}]")))
    return F.array_join(kept, "\n")


def word_tokens_lower(code: ColumnLike) -> Column:
    return F.regexp_extract_all(F.lower(col(code)), F.lit(C.WORD_PATTERN), F.lit(0))


def structural_class(toks: ColumnLike) -> Column:
    """Keyword, ``NUM``, ``ID`` or the sign itself, per token."""
    return F.transform(
        col(toks),
        lambda t: F.when(t.isin(*C.STRUCTURAL_KEYWORDS), t)
        .when(F.rlike(t, F.lit(r"^\p{Nd}+$")), F.lit("NUM"))
        .when(F.rlike(t, F.lit(r"^[\p{L}_]")), F.lit("ID"))
        .otherwise(t),
    )


def bigrams(toks: ColumnLike) -> Column:
    def pairs(t: Column) -> Column:
        n = F.size(t) - 1
        return F.when(n < 1, F.array().cast("array<string>")).otherwise(
            F.zip_with(
                F.slice(t, 1, F.greatest(n, F.lit(0))),
                F.slice(t, 2, F.greatest(n, F.lit(0))),
                lambda x, y: F.concat_ws(":", x, y),
            )
        )

    return let(col(toks), pairs)


# --- pair descriptions --------------------------------------------------------


def language_pair(a: ColumnLike, b: ColumnLike) -> Column:
    return F.concat_ws(":", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def pair_key(a: ColumnLike, b: ColumnLike) -> Column:
    return F.struct(
        F.least(col(a), col(b)).alias("lo"), F.greatest(col(a), col(b)).alias("hi")
    )


def clone_description(clone_type: ColumnLike, cross: ColumnLike) -> Column:
    """The sentence shown for a pair of Types 1 to 3, and the plain Type-4 one."""
    t, x = col(clone_type), col(cross)
    pairs = [F.lit(v) for kv in C.TYPE_DESCRIPTIONS.items() for v in kv]
    base = F.coalesce(F.try_element_at(F.create_map(*pairs), t), F.lit(""))
    return (
        F.when(x & (t == "Type-4"), F.lit(C.CROSS_LANGUAGE_TYPE4))
        .when(x, F.concat(base, F.lit(C.CROSS_LANGUAGE_SUFFIX)))
        .otherwise(base)
    )


def type4_description(mode: ColumnLike, corroborated: ColumnLike, checked: ColumnLike) -> Column:
    model = F.when(
        col(mode) == "embedding", F.lit("base-model semantic similarity")
    ).otherwise(F.lit("classifier score"))
    checks = F.when(
        col(corroborated),
        F.format_string(
            "%d bounded Python samples agree; not proof of equivalence",
            col(checked).cast("int"),
        ),
    ).otherwise(
        F.lit(
            "evaluated classifier for this language pair; behavior unverified; "
            "review required"
        )
    )
    return F.concat(F.lit("Type-4 candidate — "), model, F.lit("; "), checks)
