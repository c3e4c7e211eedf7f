"""Detection semantics on small sources."""

import itertools

import pytest
from pyspark.sql import functions as F

from tests.test_matching import plain_score
from twinspan.catalog import common as B
from twinspan.operators import copies as K
from twinspan.operators import bag_blocks
from twinspan.operators import near_miss as M
from twinspan.operators import segment as G
from twinspan.operators.store import stage
from twinspan.plans.detect import detect, prepare

from tests.conftest import SMALL

TOTAL = "def total(prices):\n    out = 0\n    for price in prices:\n        out += price\n    return out\n"


def types(detection):
    return sorted(r.clone_type for r in detection.pairs().collect())


def two(sources, a, b, ext="py"):
    return detect(sources((f"a.{ext}", a), (f"b.{ext}", b)))


def test_rename_is_type2(sources):
    renamed = TOTAL.replace("price", "item").replace("out", "acc")
    assert types(two(sources, TOTAL, renamed)) == ["Type-2"]


def test_comments_and_formatting_are_type1(sources):
    assert types(two(sources, TOTAL, TOTAL.replace("out = 0", "out  =  0  # start"))) == ["Type-1"]


@pytest.mark.parametrize("edit", [("+=", "-="), ("    return out", "        return out")])
def test_operator_or_indentation_change_is_no_copy(sources, edit):
    got = types(two(sources, TOTAL, TOTAL.replace(*edit)))
    assert "Type-1" not in got and "Type-2" not in got


def test_inconsistent_rename_is_type3(sources):
    broken = TOTAL.replace("out += price", "out += out")
    assert types(two(sources, TOTAL, broken)) == ["Type-3"]


def test_languages_must_match(sources):
    d = detect(sources(("a.java", "int f() { return 1; }"), ("a.c", "int f() { return 1; }")))
    assert types(d) == []


def test_sixty_copies_have_all_pairs(sources):
    files = [(f"f{i:02}.c", "int x = compute(y);") for i in range(60)]
    d = detect(sources(*files))
    assert d.totals().first().type1_pairs == 1770
    assert d.pairs().count() == 1770
    assert d.links().count() == 59


def test_large_class_fails_instead_of_truncating(sources):
    d = detect(sources(*[(f"f{i}.c", "int x = y;") for i in range(12)]))
    with pytest.raises(Exception, match="more than 10 members"):
        d.pairs(max_class=10).count()
    assert d.totals().first().type1_pairs == 66


def test_long_file_windows(sources):
    d = detect(sources(("long.c", "x = call(y);\n" * 200)))
    spans = sorted((r.start_line, r.end_line) for r in d.fragments.collect())
    assert spans == [(1, 80), (61, 140), (121, 200)]
    assert [(r.start_line_a, r.start_line_b) for r in d.pairs().collect()] == [(1, 121)]
    assert d.totals().first().type1_pairs == 1
    assert sorted(r.n_pairs for r in d.links().collect()) == [0, 1]


def test_nested_span_is_not_compared_with_its_parent(spark, sources):
    files = sources(("n.py", "def f():\n    def g():\n        return 1\n    return g\n"))
    spans = G.indent_blocks(G.split_lines(files))
    assert spans.count() == 2
    frags = K.fingerprints(G.usable_fragments(prepare(files, spans)))
    assert K.candidate_pair_count(frags).first().candidate_pairs == 0


def test_every_nonblank_line_is_covered(sources):
    text = "\n\n" + TOTAL + "\n".join(f"x{i} = {i}" for i in range(160)) + "\n"
    files = sources(("c.py", text))
    frags = G.fragments(files, G.indent_blocks(G.split_lines(files))).collect()
    lines = text.splitlines()
    covered = {n for f in frags for n in range(f.start_line, f.end_line + 1)}
    assert all(n in covered for n, t in enumerate(lines, 1) if t.strip())
    for f in frags:
        assert f.code.split("\n") == lines[f.start_line - 1:f.end_line]


def test_class_headers_and_short_fragments_are_not_usable(sources):
    files = sources(("a.java", "class A {"), ("b.java", "}"), ("c.py", "class A:\n"), ("d.java", "int a = b;"))
    got = G.usable_fragments(prepare(files)).select("file").collect()
    assert [r.file for r in got] == ["d.java"]


def test_python_lexer_marks_layout_and_falls_back(spark, sources):
    rows = {r.file: r.tokens for r in prepare(sources(("a.py", "def f(x):\n    return x # c\n"), ("b.py", "f = (\n"))).collect()}
    assert rows["a.py"] == ["def", "f", "(", "x", ")", ":", "NEWLINE", "INDENT", "return", "x", "NEWLINE", "DEDENT"]
    assert rows["b.py"] == ["f", "=", "("]


def test_layouts_give_the_same_counts(sources):
    parts = [TOTAL, TOTAL.replace("price", "item"), TOTAL + "# end\n"]
    flat = types(detect(sources(*[(f"{i}.py", p) for i, p in enumerate(parts)])))
    deep = types(detect(sources(*[(f"a/b{i}/x.py", p) for i, p in enumerate(parts)])))
    assert flat == deep == ["Type-1", "Type-2", "Type-2"]


def test_row_order_does_not_matter(spark, sources):
    parts = [(f"{i}.py", TOTAL.replace("price", n)) for i, n in enumerate(["price", "item", "price", "v", "item"])]
    files = sources(*parts)
    shuffled = files.orderBy(F.rand(3)).repartition(3)
    pick = lambda d: sorted((r.file_a, r.file_b, r.clone_type, r.token_sim) for r in d.links().collect())
    assert pick(detect(files)) == pick(detect(shuffled))


def test_jobs_do_not_mix(sources):
    files = sources(("a.py", TOTAL), job="one").unionByName(sources(("b.py", TOTAL), job="two"))
    assert types(detect(files)) == []


def test_fragment_guard(sources):
    with pytest.raises(Exception, match="more than 1 fragments"):
        detect(sources(("a.py", TOTAL), ("b.py", TOTAL)), max_fragments=1).totals().collect()


def test_near_miss_join_equals_brute_force(spark):
    """All pairs of distinct contents at the smallest scale, scored one by one."""
    frags = stage(B.prints(spark, SMALL).drop("tokens", "params", "code"), "brute")
    rows = frags.select("language", "near_fp", "param_fp", "near").dropDuplicates(["language", "near_fp"]).collect()
    expected = set()
    for a, b in itertools.combinations(rows, 2):
        if a.language != b.language or a.param_fp == b.param_fp:
            continue
        wa, wb = (sum(map(M_weight, r.near)) for r in (a, b))
        if 2 * min(wa, wb) < 0.75 * (wa + wb):
            continue
        score = plain_score(a.near, b.near)
        if score >= 0.75 - 1e-9:
            expected.add((*sorted((a.near_fp, b.near_fp)), round(score, 9)))
    got = {(*sorted((r.near_fp_a, r.near_fp_b)), round(r.similarity, 9)) for r in M.near_miss_join(frags, 0.5).collect()}
    assert got == expected and len(got) > 5


def test_near_miss_join_in_small_blocks_is_the_same(spark, monkeypatch):
    frags = stage(B.prints(spark, SMALL).drop("tokens", "params", "code"), "blocks")
    pick = lambda: sorted((r.near_fp_a, r.near_fp_b, r.similarity) for r in M.near_miss_join(frags, 0.5).collect())
    before = pick()
    monkeypatch.setattr(bag_blocks, "BLOCK", 7)
    monkeypatch.setattr(bag_blocks, "COLUMNS", 64)
    assert pick() == before


def contents_of(frags):
    return sorted((r.near_fp_a, r.near_fp_b, r.similarity, r.n_pairs) for r in M.near_miss_join(frags, 0.5).collect())


def test_pairs_are_scored_where_their_blocks_meet(spark, monkeypatch):
    """No list is fetched for a pair of shapes that have few contents."""
    frags = stage(B.prints(spark, SMALL).drop("tokens", "params", "code"), "scored")
    expected = contents_of(frags)
    fetched = []
    verify = M.verify
    monkeypatch.setattr(M, "verify", lambda pairs, distinct, t: fetched.append(pairs.count()) or verify(pairs, distinct, t))
    assert contents_of(frags) == expected and expected and fetched == [0]


def test_shapes_of_many_contents_are_the_same(sources, monkeypatch):
    """Contents that differ in literals are one shape; whether they travel with it or are fetched, the pairs are the same."""
    body = "int f(int a) {{ int b = a * {0}; while (b > {0}) {{ b -= a; g(b, \"x{0}\"); }} {1} return b; }}"
    files = sources(*[(f"{k}{i}.java", body.format(i, extra)) for k, extra in enumerate(("", "b += 1;", "h(a); b += a;")) for i in range(2 + 2 * k)])
    frags = stage(K.fingerprints(G.usable_fragments(prepare(files, None, False))), "many")
    monkeypatch.setattr(M, "AT_HAND", 9)
    expected = contents_of(frags)
    monkeypatch.setattr(M, "AT_HAND", 2)
    assert contents_of(frags) == expected and len(expected) > 10


def M_weight(token):
    from twinspan.functions.matching import weight

    return weight(token)
