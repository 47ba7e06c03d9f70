"""Column functions and fingerprints on edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from twinfold.functions import fingerprints as fp
from twinfold.functions import similarity as sim
from twinfold.functions import text as tx

SPACES = ["　", "\xa0", "\x1c", "\x85", " \t\n", " ", "᠎", "​"]


def apply(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    out = rows.select("i", make(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(out, key=lambda r: r.i)]


def test_strip_and_split_follow_unicode(spark):
    values = [f"{a}Ab{b}Cd{a}" for a in SPACES for b in SPACES] + ["", "x", "İstanbul ΟΔΟΣ"]
    assert apply(spark, values, tx.normalize_text) == [v.strip().lower() for v in values]
    assert apply(spark, values, tx.words) == [v.split() for v in values]
    assert apply(spark, values, tx.sanitize_text) == [" ".join(v.split()) for v in values]
    assert apply(spark, [None, "abcdef"], lambda c: tx.sanitize_text(c, 4)) == ["", "abcd"]


def test_title_is_first_line(spark):
    def expected(text):
        lines = [line.strip() for line in text.splitlines() if line.strip()]
        line = lines[0] if lines else "stem"
        return line[:117] + "..." if len(line) > 120 else line

    values = [
        "One\nTwo", "\r\n \n  Second \r third", "\x0cA\x1cB", "a\x1fb\nc", "", " \n ", "x" * 120, "x" * 121,
        "\U0001f600" * 121, "  y\x85z", "y z", "　行一\n行二",
    ]
    assert apply(spark, values, lambda c: tx.derive_title(c, F.lit("stem"))) == [expected(v) for v in values]


def test_title_of_a_line_with_blanks_where_it_is_cut(spark):
    """Characters after the first 121 decide only where the 121st is a blank of the line."""
    values = [
        "a" * 120 + " ", "a" * 120 + " \nb", "a" * 120 + "  b", "abc" + " " * 200, "abc" + " " * 200 + "x", "abc" + " " * 200 + "\nx",
        "x" * 119 + "\u3000 z", "x" * 117 + " " * 4 + "y",
    ]
    want = ["a" * 120, "a" * 120, "a" * 117 + "...", "abc", "abc" + " " * 114 + "...", "abc", "x" * 117 + "...", "x" * 117 + "..."]
    assert apply(spark, values, lambda c: tx.derive_title(c, F.lit("stem"))) == want


def test_titles_do_not_search_long_lines(spark):
    """A text of one line pays for its first characters, not for its length."""
    line = F.concat(F.lit("x"), F.repeat(F.lit("word "), 4_000_000))
    rows = spark.range(8).select(tx.derive_title(line, F.lit("stem")).alias("t"), F.length(line).alias("n"))
    plan = rows._jdf.queryExecution().toString()
    assert "substring(ltrim(" in plan and rows.where(F.col("t") == "x" + ("word " * 30)[:116] + "...").count() == 8


def test_distinct_sorts():
    draw = np.random.default_rng(5)
    for values in (np.array([], dtype=np.int64), draw.integers(-9, 9, 300), draw.integers(0, 1 << 63, 200, dtype=np.uint64)):
        assert np.array_equal(fp._distinct(values), np.unique(values))


def test_source_names(spark):
    values = [None, "", "  ", "My News-Site.com", "__a  b..c--", "A_b"]
    assert apply(spark, values, tx.normalize_source) == ["unknown", "unknown", "", "my_news_site_com", "_a_b_c_", "a_b"]


def test_validity_rules(spark):
    codes = ["en", "en-US", "zh-CN", "e", "eng", "en-", "en-U", "en-USA", "e1", "en_US", "", None, "日本", "en-US-x", "en\n"]
    good = [True, True, True, False, False, False, False, False, False, False, False, False, True, False, False]
    assert apply(spark, codes, tx.is_language_code) == good
    assert apply(spark, ["a", " ", "", None, "　"], tx.is_article_id) == [True, False, False, False, False]
    ids = ["cluster_1", "cluster_", "cluster", "Cluster_1", "", None]
    assert apply(spark, ids, tx.is_cluster_id) == [True, False, False, False, False, False]
    ranges = spark.sql("""SELECT * FROM VALUES (1, timestamp'2024-01-01', timestamp'2024-01-02'), (2, timestamp'2024-01-02', timestamp'2024-01-02'),
        (3, timestamp'2024-01-03', timestamp'2024-01-02'), (4, NULL, timestamp'2024-01-02'), (5, timestamp'2024-01-01', NULL) AS t(i, a, b)""")
    found = [r.ok for r in ranges.orderBy("i").select(tx.is_date_range(F.col("a"), F.col("b")).alias("ok")).collect()]
    assert found == [True, True, False, True, True]


def test_title_tokens(spark):
    values = ["Hello, HELLO world-2", "新闻聚类 abc新", "", "—", "ab新闻cd", "ひらがな"]
    expected = [["hello", "world", "2"], ["新闻", "闻聚", "聚类", "abc", "新"], [], [], ["ab", "新闻", "cd"], ["ひら", "らが", "がな"]]
    assert apply(spark, values, tx.title_tokens) == expected


def test_shingles(spark):
    values = ["", "abcd", "abcde", "abcdef", "a\nb\U0001f600c d", "新闻聚类系统", "aaaaaaa"]
    expected = [[v[i : i + 5] for i in range(len(v) - 4)] for v in values]
    assert apply(spark, values, sim.shingles) == expected
    assert [len(e) for e in expected[:4]] == [0, 0, 1, 2]


@pytest.mark.parametrize("size", [1, 3, 8])
def test_fingerprints_of_other_shingle_sizes(size):
    texts = ["", "ab", "abcabcabc", "the quick brown fox", "\U0001f600" * 9]
    pieces, owned = fp.shingle_index(texts, size)
    for text, rows in zip(texts, owned):
        assert {pieces[i] for i in rows} == fp_set(text, size)


def fp_set(text, size):
    return {text[i : i + size] for i in range(len(text) - size + 1)}


def test_shingles_of_very_many_characters():
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 7000)))
    pieces, owned = fp.shingle_index([wide, "abcdef", ""], 5)
    assert {pieces[i] for i in owned[0]} == fp_set(wide, 5)
    assert {pieces[i] for i in owned[1]} == {"abcde", "bcdef"} and len(owned[2]) == 0


def test_fingerprints_run_without_the_package(tmp_path):
    """Workers need not have the package: the functions must not be pickled by name."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "blob").write_bytes(cloudpickle.dumps((fp.minhashes, fp.simhash_value, fp.band_hashes)))
    code = "from pyspark import cloudpickle; cloudpickle.load(open('blob', 'rb'))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)


def test_simhash(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "|", "ünï", "新闻"]
    values = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)] + ["", "| | | x"]
    found = apply(spark, values, fp.simhash)
    assert [v & (1 << 64) - 1 for v in found] == [brute.simhash(v) for v in values]
    assert apply(spark, ["| a | |"], lambda c: sim.simhash_hex(fp.simhash(c))) == ["580b3adfa04fb947"]
    assert len(set(apply(spark, ["a b c", "c a b", "b c a"], fp.simhash))) == 1


def test_minhash_by_aggregation_agrees(spark):
    """The same values as one aggregate per permutation over exploded shingles."""
    values = ["the quick brown fox jumps", "the quick brown fox jumped", "新闻聚类系统 abc", "abcd"]
    a, b = fp.coefficients(120)
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    hashed = rows.select("i", F.explode(sim.shingles(F.col("x"))).alias("s")).select(
        "i", (F.conv(F.substring(F.md5("s"), 25, 8), 16, 10).cast("bigint") % fp.PRIME).alias("h")
    )
    minima = [F.min((F.col("h") * int(a[i]) + int(b[i])) % fp.PRIME) for i in range(120)]
    expected = {r[0]: list(r[1:]) for r in hashed.groupBy("i").agg(*minima).collect()}
    found = apply(spark, values, fp.minhash)
    assert found == [expected.get(i, []) for i in range(len(values))]


def test_jaccard(spark):
    rows = spark.createDataFrame(
        [(["a", "b"], ["b", "a", "a"]), ([], []), (["a"], []), (list("abcd"), list("abcde")), (list("abc"), list("bcd"))],
        "x array<string>, y array<string>",
    )
    one = [r[0] for r in rows.select(sim.jaccard(F.col("x"), F.col("y"))).collect()]
    two = [r[0] for r in rows.select(sim.jaccard(F.col("y"), F.col("x"))).collect()]
    assert one == two == [1.0, 0.0, 0.0, 0.8, 0.5]


def test_hamming(spark):
    rows = spark.createDataFrame([(0, 7), (0, 15), (-1, 0), (5, 5)], "x bigint, y bigint")
    assert [r[0] for r in rows.select(sim.hamming(F.col("x"), F.col("y"))).collect()] == [3, 4, 64, 0]


def test_top_terms(spark):
    values = ["b b a a c", "a b c", "", None, "I a x", " ".join(f"w{i:02}" for i in range(12)) + " w11", "Xx xX yy " + "zz " * 13]
    found = apply(spark, values, fp.top_terms)
    pairs = [[(t.term, t.weight) for t in terms] for terms in found]
    assert pairs[0] == [] and pairs[1] == [] and pairs[2] == [] and pairs[3] == [] and pairs[4] == []
    assert pairs[5] == [("w11", 0.182)] + [(f"w{i:02}", 0.091) for i in range(9)]
    assert pairs[6] == [("zz", 0.812), ("xx", 0.125), ("yy", 0.062)]


def test_minhash_of_long_and_rich_texts(monkeypatch):
    """Texts of many different characters, texts cut into blocks, and a text of five million characters."""
    import random
    import tracemalloc

    import numpy as np
    import pandas as pd

    rnd = random.Random(13)
    rich = ["".join(chr(rnd.randrange(0x4E00, 0x9F00)) for _ in range(n)) for n in (9000, 9001, 4, 0, 300)]
    rich += [rich[0][:4000] + rich[1][:4000], "abcabcabcabc", "\U0001f600" * 9]
    a, b = fp.coefficients(120)
    for fold in (700, fp._FOLD):
        monkeypatch.setattr(fp, "_FOLD", fold)
        found = list(fp.minhashes(pd.Series(rich), 5, a, b, {}))
        for text, (n, values) in zip(rich, found):
            assert n == len(brute.shingles(text))
            assert (values.tolist() if n else []) == brute.minhash(text)
    long = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz "), 5_000_000))
    tracemalloc.start()
    [(n, values)] = list(fp.minhashes(pd.Series([long]), 5, a, b, {}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    hashes = fp._hashes({long[i : i + 5] for i in range(len(long) - 4)}, 4, {}) % np.uint64(fp.PRIME)
    assert n == len(hashes)
    want = np.min([fp.permuted(hashes[i : i + 100_000], a, b).min(axis=0) for i in range(0, n, 100_000)], axis=0)
    assert (values == want).all()
    assert peak < 1_200_000_000


def test_known_shingles_are_not_hashed_again(monkeypatch):
    """What a task has hashed it finds by id, also when it may remember a few shingles only."""
    import pandas as pd

    texts = ["the quick brown fox", "the quick brown cat", "", "\U0001f600" * 9, "新闻聚类系统 the quick"]
    a, b = fp.coefficients(120)
    want = [brute.minhash(text) for text in texts]
    for least in (3, 30, 1000):
        monkeypatch.setattr(fp, "_KNOWN", least)
        known = {}
        for group in (10, 1000):
            monkeypatch.setattr(fp, "_GROUP", group)
            assert [v.tolist() if n else [] for n, v in fp.minhashes(pd.Series(texts), 5, a, b, known)] == want
            assert len(known["ids"]) <= least
    monkeypatch.setattr(fp, "_digests", None)
    assert [v.tolist() if n else [] for n, v in fp.minhashes(pd.Series(texts), 5, a, b, known)] == want
