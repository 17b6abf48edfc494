"""Text, facet, vector and decision functions on literal rows."""

import random

import pytest
from corpusmith.functions import decisions as D
from corpusmith.functions import facets as FA
from corpusmith.functions import text as T
from corpusmith.functions import vectors as V
from pyspark.sql import functions as F


def each(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_windows(text, size, overlap):
    words = text.split()
    if len(words) <= size:
        return [text.strip()] if words else []
    step, out, i = max(1, size - overlap), [], 0
    while True:
        out.append(" ".join(words[i : i + size]))
        if i + size >= len(words):
            return out
        i += step


def test_windows(spark):
    r = random.Random(1)
    texts = ["", "  a  b ", " \t\n"] + [" ".join(map(str, range(r.randint(1, 40)))) for _ in range(60)]
    for size, overlap in ((4, 2), (5, 0), (7, 6), (1, 0)):
        assert each(spark, texts, lambda x, s=size, o=overlap: T.windows(x, s, o)) == [plain_windows(t, size, overlap) for t in texts]


def test_tokens_and_stop_words(spark):
    assert each(spark, ["The Rhéa_2 of N?"], T.tokens) == [["the", "rhéa", "2", "of", "n"]]
    assert each(spark, ["Who is N?", "what is the", ""], T.content_tokens) == [["n"], ["what", "is", "the"], []]


def test_cutting(spark):
    long = "[XG] A > B: " + "word " * 60
    got = each(spark, ["[XG] A > B: short  text", long, "x" * 250, None], T.snippet)
    assert got[0] == "short text" and got[1] == ("word " * 40).strip() + "…" and got[2] == "x" * 200 + "…" and got[3] == ""
    assert each(spark, ["a > b > c", " none "], T.strip_breadcrumb) == ["b > c", "none"]
    assert each(spark, ["x" * 319 + " yz", "ok"], T.clip) == ["x" * 319 + "…", "ok"]


def test_normalise(spark):
    assert each(spark, ["the Blade , a sword ( of  light ) ; Kay 's\u00a0end\u200b ."], T.normalise) == ["the Blade, a sword (of light); Kay's end."]


def test_labels_and_fields(spark):
    assert each(spark, [" LV ", "drop RATE", ""], T.label) == ["Level", "Drop rate", ""]


def test_paths_hosts_and_keys(spark):
    assert each(spark, [r"no C:\a b or /srv/x/y.log, but / and a/b", "see http://h/a/b"], T.scrub_paths) == ["no <path> b or <path>, but / and a/b", "see http://h/a/b"]
    assert each(spark, ["Ex.org:80", "[::1]:8000", " a "], T.host_name) == ["ex.org", "[::1]", "a"]
    assert each(spark, ["1.1.1.1, 2.2.2.2", "  ", None], lambda x: T.client_key(x, F.lit("peer"), F.lit(True))) == ["1.1.1.1", "peer", "peer"]
    assert each(spark, ["7", "500", "soon", None], lambda x: T.retry_wait(x, F.lit(24))) == [7, 120, 24, 24]


def test_events_and_links(spark):
    assert each(spark, ["event: text\ndata: {\"a\":1}\n\n", "data: x\ndata: y"], lambda x: T.sse_parse(x)["kind"]) == ["text", "message"]
    assert each(spark, ["data: x\ndata: y"], lambda x: T.sse_parse(x)["payload"]) == ["x\ny"]
    assert each(spark, ["a [2][1] b [2] c [9] [x]"], lambda x: T.citations(x, F.lit(3))) == [[2, 1]]
    assert each(spark, ["https://a/b", "javascript:x", None], T.safe_href) == ["https://a/b", "#", "#"]
    assert each(spark, ["https://h/wiki/A_b%20c?x=1", "https://h/w/100%_d/"], T.source_name) == ["A b c", "100% d"]


CAT = FA.Catalogue(phrases=((r"third\s+game", "XC3"), (r"old\s+game\b", "XG"), (r"episode\s+one", "XS1"), (r"episode\s+two", "XS2")))


@pytest.mark.parametrize(
    ("title", "text", "label", "games"),
    [
        ("A (XC3)", "{{XC1 enemy data}}", "XC3", ["XC3"]),
        ("A (XCDE) (other)", None, "XC1", ["XC1"]),
        ("A (XS)", "x", "XS", ["XS1", "XS2", "XS3"]),
        ("A (XS1&2)", "x", "XS", ["XS1", "XS2"]),
        ("A", None, "series", []),
        ("A", "", "series", []),
        ("A", "{{XC3 character infobox|a=b}} [[Category:Old game people]]", "XC3", ["XC3", "XG"]),
        ("A", "{{Character infobox}} [[Category:Old game people]] [[Category:People (XC2T)]]", "XG", ["XC2", "XG"]),
        ("A", "{{Character infobox}} [[Category:Episode one]] [[Category:Episode two]]", "XS", ["XS1", "XS2"]),
        ("A", "{{Character infobox}} [[Category:Episode one]] [[Category:Episode two]] [[Category:Old game]]", "series", ["XG", "XS1", "XS2"]),
        ("A", "[[Category:Third game lore]] [[category : Old game lore|x]]", "series", ["XC3", "XG"]),
        ("A", "[[Category:Third game lore]]", "XC3", ["XC3"]),
        ("A", "see {{XC2|Gormott}}", "XC2", ["XC2"]),
        ("A", "see {{XC2|Gormott}} {{XS|B}}", "series", []),
        ("A", "see {{XC2|G}} {{XG|B}}", "series", []),
    ],
)
def test_tagging(spark, title, text, label, games):
    df = spark.createDataFrame([(title, text)], "t string, w string")
    row = df.select(FA.derive_label(F.col("t"), F.col("w"), CAT).alias("label"), FA.derive_memberships(F.col("t"), F.col("w"), CAT).alias("games")).first()
    assert (row.label, row.games) == (label, games)


def test_memberships_and_filters(spark):
    assert each(spark, ["XS", "XC2", "series", None], FA.fallback_memberships)[:2] == [["XS1", "XS2", "XS3"], ["XC2"]]
    assert all(len(g) == 8 for g in each(spark, ["series", None], FA.fallback_memberships))
    assert FA.filter_code("XS") is None and FA.filter_code("") is None and FA.filter_code("XG") == "XG"
    df = spark.createDataFrame([(1, ["XG"]), (2, []), (3, None)], "i int, games array<string>")
    got = df.select("i", FA.flags(F.col("games"))["g_XC1"].alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [False, True, True]


def test_vectors(spark):
    vectors = [[3.0, 4.0], [0.0, 0.0], [float("nan"), 2.0], [float("inf"), 0.0]]
    assert each(spark, vectors, V.l2_normalise, "array<double>") == [[0.6, 0.8], [0.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    assert each(spark, vectors[:1], lambda v: V.cosine_distance(v, v), "array<double>") == [0.0]
    unit = each(spark, ["Blade blade of", ""], V.hash_embedding)
    assert abs(sum(x * x for x in unit[0]) - 1) < 1e-12 and sorted(set(unit[0]))[-1] > 0.8 and not any(unit[1])
    assert each(spark, ["the cat the dog"], lambda p: V.overlap_score(F.lit("The dog"), p)) == [3.0]


def test_decisions(spark):
    replies = ['{"tier":{"choice":"fast","confidence":0.9}}', '{"tier":{"choice":"huge","confidence":0.9}}', '{"tier":{"choice":"fast","confidence":"NaN"}}', '{"tier":{"choice":"fast"}}', "junk", None]
    got = each(spark, replies, lambda x: D.route(x, F.lit(None).cast("string"), F.lit(True)))
    assert [(r.tier, r.source) for r in got] == [("fast", "service"), *[("thinking", "fallback")] * 5]
    assert each(spark, replies[:1], lambda x: D.route(x, F.lit("scholar"), F.lit(False)))[0].source == "override"
    assert each(spark, [0.8, 0.79, float("nan"), float("inf"), None], lambda c: D.not_covered(F.lit("not_covered"), c), "double") == [True, False, False, False, False]
    verdict = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("confidence"))
    again = lambda a, b, tier: tuple(each(spark, ["x"], lambda _: D.replay(a, b, F.lit(tier), 0.8))[0])
    no, yes = verdict("not_covered", 0.9), verdict("answered", 0.9)
    assert again(no, no, "fast") == (True, True) and again(no, yes, "fast") == (True, False)
    assert again(no, yes, "scholar") == (False, True) and again(yes, no, "fast") == (False, False)
    assert each(spark, ["https://api.h.ai/x", "http://h.ai", "https://h.ai.evil.com", None], lambda u: D.allowed_url(u, "h.ai")) == [True, False, False, False]


def test_strip_ends_at_the_end_of_the_text(spark):
    """Java's $ also stands before a last line mark such as U+0085, SQL's does not: blanks before that are inside the text."""
    texts = ["a \u0085", "\t a\u2028", " \x0b\x0c\r\n", "\u00a0 a \n", " a \u2029 ", "", None]
    assert each(spark, texts, T.strip) == [t if t is None else t.strip(" \t\n\x0b\x0c\r") for t in texts]
