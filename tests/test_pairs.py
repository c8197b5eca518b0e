"""Index, pairs, ranking and chains against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import alphabet as A
from lexloom.operators import anagram as G
from lexloom.operators import chain as H
from lexloom.operators import pairs as P
from lexloom.operators import rank as R

LETTERS = {c: n**5 for n, c in enumerate("_abcde", 102)}
SYMBOLS = [("*", 100**5), ("$", 101**5), *LETTERS.items()]


def vocabulary(spark, n=150, seed=1):
    r = random.Random(seed)
    words = {"".join(r.choices("abcdeABñ!", k=r.randint(2, 7))) for _ in range(n)} | {"ab_cd", "ab_ce", "abb_cd", "x"}
    return spark.createDataFrame([(w, r.choice([1, 2, 5, 1000, 1007])) for w in sorted(words)], "word string, freq bigint")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("ld,sent", [(1, 10**6), (2, 10**6), (2, 10)])
def test_index_shapes_agree(spark, ld, sent, monkeypatch):
    monkeypatch.setattr(G, "SENT_KEYS", sent)
    monkeypatch.setattr(G, "MEET_ROWS", 500)
    voc = vocabulary(spark)
    ana = G.anagram_table(voc, LETTERS)
    keys = G.keys_in_band(ana, 2, 35)
    conf = A.confusions(spark, SYMBOLS, ld)
    known = {r.hash for r in keys.collect()}
    want = {(r.kwc, h) for r in conf.collect() for h in known if h + r.kwc in known}
    same = lambda df: sorted(tuple(r) for r in df.select("kwc", "hash").collect()) == sorted(want)
    assert same(G.index_by_confusion(keys, conf)) and same(G.index_by_difference(keys, SYMBOLS, ld)) and same(G.build_index(keys, SYMBOLS, ld, conf))
    few = keys.orderBy("hash").limit(20)
    chosen = {r.hash for r in few.collect()}
    want = {(k, h) for k, h in want if h in chosen or h + k in chosen}
    assert same(G.index_by_focus(keys, conf, few)) and same(G.index_by_confusion(keys, conf, few)) and same(G.index_by_difference(keys, SYMBOLS, ld, few)) and same(G.build_index(keys, SYMBOLS, ld, conf, few))
    assert G.index_by_confusion(keys, conf, few.where("false")).count() == 0
    assert sum(r.n for r in G.confusion_stats(G.index_by_confusion(keys, conf)).collect()) == len({(r.kwc, h) for r in conf.collect() for h in known if h + r.kwc in known})


@pytest.mark.parametrize("confusions", [(1, 7, 40, 350), tuple(range(1, 2000, 3))])
def test_index_by_focus_over_ranges(spark, confusions, monkeypatch):
    monkeypatch.setattr(G, "RANGE_KEYS", 20)
    r = random.Random(3)
    keys, foci = set(r.sample(range(3000), 400)), set(r.sample(range(3000), 300))
    table = lambda x, name: spark.createDataFrame([(v,) for v in sorted(x)], f"{name} bigint")
    got = G.index_by_focus(table(keys, "hash"), table(confusions, "kwc"), table(foci, "hash"))
    want = {(c, k) for c in confusions for k in keys if k + c in keys and (k in foci or k + c in foci)}
    assert sorted(tuple(x) for x in got.select("kwc", "hash").collect()) == sorted(want) != []


def test_index_by_focus_makes_no_pair_of_the_band(spark):
    # 200,000 foci with as many keys within the largest confusion: 40 billion pairs of a focus and a key
    keys = spark.range(200_000).select(F.col("id").alias("hash"))
    conf = spark.createDataFrame([(3,), (199_990,)], "kwc bigint")
    got = G.index_by_focus(keys, conf, keys).groupBy("kwc").count()
    assert {tuple(r) for r in got.collect()} == {(3, 199_997), (199_990, 10)}


def test_foci(spark):
    f = spark.createDataFrame([("Huis", 1), ("huis", 200), ("boom", 3), ("Kat", 200), ("ab_boom", 1), ("huis_kat", 5)], "word string, freq bigint")
    assert {r.word for r in G.foci(f, LETTERS, 100).collect()} == {"boom", "ab_boom", "huis_kat"}
    assert {r.word for r in G.foci(f, LETTERS, 100, parts=True).collect()} == {"boom", "ab_boom"}


def brute_pairs(voc, index, hashes, A_, d, low):
    """The definition, pair by pair."""
    freq = {w: f for w, f in voc.items() if low <= len(w) <= 35}
    lf = defaultdict(int)
    groups = defaultdict(list)
    for w, f in freq.items():
        groups[w.lower()].append(f)
    for w, fs in groups.items():
        lf[w] = sum(f - A_ if f >= A_ else f for f in fs) + (A_ if max(fs) >= A_ else 0)
    by = defaultdict(list)
    for h, w in hashes:
        if w in freq:
            by[h].append(w)
    records, parts = {}, Counter()

    def take(w1, w2, h1, h2, kwc):
        if distance(w1.lower(), w2.lower()) > d and kwc:
            return
        l1, l2 = lf[w1.lower()], lf[w2.lower()]
        if l1 > l2 or (l1 == l2 and h1 < h2):
            w1, w2, l1, l2 = w2, w1, l2, l1
        if l1 >= A_ or (not kwc and l2 < A_):
            return
        p1, p2 = [p for p in w1.split("_") if p], [p for p in w2.split("_") if p]
        if len(p1) == len(p2) > 1:
            diff = [(a, b) for a, b in zip(p1, p2, strict=True) if a.lower() != b.lower()]
            if len(diff) > 1:
                return
            if diff:
                if lf[diff[0][0].lower()] < A_:
                    parts[diff[0]] += 1
                return
        ld = distance(w1.lower(), w2.lower())
        if not kwc and ld != 2:
            return
        a, b = w1.lower(), w2.lower()
        records[w1, w2] = (freq[w1], l1, freq[w2], l2, kwc, ld, max(len(a), len(b)) - ld, int(l2 >= A_), int(a[0] == b[0]), int(len(a) > 1 and len(b) > 1 and a[-2:] == b[-2:]), 0)

    for kwc, h in index:
        for w1 in by[h]:
            for w2 in by[h + kwc]:
                take(w1, w2, h, h + kwc, kwc)
    if d >= 2:
        for h in {h for _, h in index}:
            ws = sorted(by[h])
            for i, w1 in enumerate(ws):
                for w2 in ws[i + 1 :]:
                    take(w1, w2, h, h, 0)
    return records, parts


@pytest.mark.parametrize("ld,dense", [(1, 400), (2, 0)])
def test_pairs(spark, ld, dense, monkeypatch):
    monkeypatch.setattr(P, "DENSE", dense)
    voc = vocabulary(spark)
    ana = G.anagram_table(voc, LETTERS)
    index = G.index_by_difference(G.keys_in_band(ana, 2, 35), SYMBOLS, ld)
    got = P.find_pairs(index, ana, voc, artifrq=1000, distance=ld, low_length=2)
    want, parts = brute_pairs({r.word: r.freq for r in voc.collect()}, [tuple(r) for r in index.select("kwc", "hash").collect()], [tuple(r) for r in ana.select("hash", "word").collect()], 1000, ld, 2)
    rows = [tuple(r) for r in got.records.collect()]
    assert len(rows) == len(want) > 10
    assert {(r[0], r[3]): (r[1], r[2], r[4], r[5], *r[6:13]) for r in rows} == want
    assert {(r.part1, r.part2): r.n for r in got.part_counts.collect()} == parts


def test_near_pairs_are_those_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(P, "SHORTENED", 300)
    more = [("ab~cd", 3), ("ab#ce", 1000), ("Ab_Cd", 4), ("aaab", 1), ("abaa", 2), ("AAAB", 1001), ("aa!b", 1), ("aa!!b", 1), ("日本語ab", 1), ("日本話ab", 3), ("a😀bc", 1), ("abc", 2), ("abc", 7), (None, 1), ("ABC", None)]
    voc = vocabulary(spark, 400).unionByName(spark.createDataFrame(more, "word string, freq bigint"))
    voc = voc.unionByName(vocabulary(spark, 30, 2).select(F.concat("word", F.lit("_abcde")).alias("word"), "freq"))
    ana = G.anagram_table(voc, LETTERS)
    index = G.index_by_difference(G.keys_in_band(ana, 3, 11), SYMBOLS, 1)
    want = P.find_pairs(index, ana, voc, artifrq=1000, distance=1, low_length=3)
    got = P.find_near_pairs(voc, LETTERS, SYMBOLS, artifrq=1000, low_length=3, band=(3, 11))
    for name in ("records", "short", "ambiguous", "part_counts"):
        a, b = getattr(want, name), getattr(got, name)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []


def test_shuffle_files_go_with_the_query(spark):
    from lexloom.session import Scratch

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    before = set(files())
    kept = Scratch(spark).save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not [x for x in set(files()) - before if x.endswith(".data")]
    assert kept.count() == 7


def test_short_and_ambiguous_pairs(spark):
    voc = spark.createDataFrame([("aa_bb", 1), ("aa_bc", 2), ("ea_bb", 1), ("ea_bc", 2), ("abcde_a", 1), ("abcd_a", 3), ("abcde", 4), ("abcd", 4)], "word string, freq bigint")
    ana = G.anagram_table(voc, LETTERS)
    index = G.index_by_difference(G.keys_in_band(ana, 2, 35), SYMBOLS, 1)
    got = P.find_pairs(index, ana, voc, artifrq=1000, distance=1, low_length=4)
    assert {r.pair: r.ngram_pairs for r in got.ambiguous.collect()}["bb~bc"] == ["aa_bb~aa_bc", "ea_bb~ea_bc"]
    assert {(r.variant, r.candidate): r.ngram_points for r in got.short.collect()}[("bb", "bc")] == 2
    assert [(r.part1, r.part2, r.n) for r in got.part_counts.collect()] == [("abcde", "abcd", 1)]
    with pytest.raises(ValueError):
        P.find_pairs(index, ana, voc, artifrq=0)


def records(spark, n=400, seed=3):
    r = random.Random(seed)
    rows = {}
    for _ in range(n):
        v, c = r.choice(["aab", "ab_cd", "abc", "hot", "hot"]), "".join(r.choices("abcAB", k=4))
        rows[v, c] = (v, 3, 3, c, r.choice([1, 5, 1000 + r.randint(0, 3)]), 5, r.choice([0, 7, 11, 13]), r.randint(1, 2), r.randint(1, 5), r.randint(0, 1), r.randint(0, 1), r.randint(0, 1), r.randint(0, 1), r.choice([0, 0, 2]))
    return spark.createDataFrame(list(rows.values()), "variant string, variant_freq bigint, low_variant_freq bigint, candidate string, candidate_freq bigint, low_candidate_freq bigint, kwc bigint, ld int, cls int, canon int, fl int, ll int, khc int, ngram_points bigint")


def test_rank_scores_and_hot_variants(spark, monkeypatch):
    rec = records(spark)
    plain = {(r.variant, r.candidate): tuple(r[c] for c in sorted(r.asDict())) for r in R.rank_pairs(rec, clip=10_000, debug=True).collect()}
    monkeypatch.setattr(R, "HOT_ROWS", 5)
    monkeypatch.setattr(R, "HOT_SHARE", 1000)
    split = {(r.variant, r.candidate): tuple(r[c] for c in sorted(r.asDict())) for r in R.rank_pairs(rec, clip=10_000, debug=True).collect()}
    assert plain == split
    scores = R.rank_pairs(rec, clip=10_000).groupBy("variant").agg(F.sum("score").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s == pytest.approx(r.n - 1 if r.n > 1 else 1) for r in scores)
    assert R.rank_pairs(rec).count() == rec.select("variant").distinct().count()
    assert R.rank_pairs(rec.where("false")).count() == 0
    with pytest.raises(ValueError):
        R.rank_pairs(rec, skip=tuple(range(1, 15)))


def test_medians_truncate(spark):
    rows = spark.createDataFrame([(1, 2), (1, 5), (2, 3), (2, 3), (2, 9), (3, None)], "k int, v bigint")
    got = {r.k: r.median for r in R.integer_median(rows.where("v is not null"), ["k"], "v").collect()}
    assert got == {1: 3, 2: 3}


def test_weak_ngrams_go(spark):
    rec = spark.createDataFrame([("aab", "x", 2), ("aab_c", "y", 0), ("d_e", "z", 0), ("aab_d", "w", 3)], "variant string, candidate string, ngram_points int")
    assert {r.candidate for r in R.drop_weak_ngrams(rec).collect()} == {"x", "z", "w"}


def test_complement_counts(spark):
    a, b, c, d = (LETTERS[x] for x in "abcd")
    counts = spark.createDataFrame([(abs(a + b - c - d), 1), (abs(a - c), 4), (abs(b - d), 3), (abs(a - d), 2)], "kwc bigint, pairs1 bigint")
    conf = spark.createDataFrame([(abs(a + b - c - d), "ab~cd"), (5, "a~b")], "kwc bigint, example string")
    # a-c and b-d have equal differences of ranks but not of fifth powers; c of four, d of three
    assert {r.kwc: r.pairs2 for r in R.complement_counts(counts, conf, LETTERS).collect()} == {abs(a + b - c - d): 7}


def test_chain(spark):
    rows = [("aaa", 1, "aab", 2, 5, 1, 0.9), ("aaa", 1, "ccc", 9, 5, 1, 0.8), ("aab", 2, "abb", 3, 6, 1, 1.0), ("abb", 3, "bbb", 9, 7, 1, 1.0), ("x", 1, "y", 2, 1, 1, 1.0)]
    r = spark.createDataFrame(rows, "variant string, variant_freq bigint, candidate string, candidate_freq bigint, kwc bigint, ld int, score double")
    got = {x.variant: x for x in H.chain(r, LETTERS).collect()}
    assert {v: x["head"] for v, x in got.items()} == {"aaa": "bbb", "aab": "bbb", "abb": "bbb", "x": "y"}
    assert got["aaa"].kwc == 3 * (LETTERS["b"] - LETTERS["a"]) and got["aaa"].ld == 3 and got["abb"].kwc == 7 and got["aaa"].head_freq == 9
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "word string, head string")
    with pytest.raises(ValueError):
        H.roots(loop)
    long = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(300)], "word string, head string")
    assert {x.root for x in H.roots(long).collect()} == {"0300"}
    odd = spark.createDataFrame([("ab", "abñ", X.FOREIGN_CHAR, 1.0), ("ab", "abc", 7, 0.5)], "variant string, candidate string, kwc bigint, score double")
    assert [x.candidate for x in H.drop_unknown_letters(odd, "abc").collect()] == ["abc"]


def brute_clean(recs, valid, low):
    """The sequential rule over all records at once, caseless."""
    import re

    recs = [dict(v=v.lower(), raw=[p for p in v.split("_") if p], vp=[p for p in v.lower().split("_") if p], h=h.lower(), hp=[p for p in h.lower().split("_") if p], gone=False, done=False) for v, h in recs]
    freq = Counter(p for r in recs if len(r["vp"]) > 1 for p in r["vp"] if p not in valid)
    for r in recs:
        r["gone"] = len(r["vp"]) > 1 and len("".join(r["vp"])) <= low
    done = {}
    for part, _ in sorted(freq.items(), key=lambda x: (-x[1], x[0])):
        tally = {}
        for r in recs:
            if part in [p for p in re.split("[_-]", r["v"]) if p]:
                for c in [p for p in re.split("[_-]", r["h"]) if p]:
                    tally[c] = tally.get(c, 0) + 1
        order = {c: i for i, c in enumerate(tally)}
        for cand in sorted(tally, key=lambda c: (-tally[c], order[c])):
            uniq = set()
            for r in recs:
                if r["gone"] or r["done"]:
                    continue
                if len(r["vp"]) == 1:
                    if r["v"] == part and cand in r["h"]:
                        done[r["h"]] = r["v"]
                        r["done"] = True
                        if len(r["hp"]) == 1:
                            uniq.add(r["v"])
                    continue
                if any(p in uniq for p in r["raw"]):
                    r["gone"] = True
                    continue
                if cand in r["hp"] and part in r["vp"]:
                    if cand in done and (part in uniq or done[cand] in r["v"]):
                        r["gone"] = True
                    else:
                        done[cand] = r["v"]
                        r["done"] = True
    return [r["gone"] for r in recs]


@pytest.mark.parametrize("seed", range(3))
def test_clean_chains(spark, seed, monkeypatch):
    from lexloom.operators import lookup as K

    monkeypatch.setattr(K, "HOT_ROWS", 5 if seed else 100_000)  # hot parts and heads, too
    r = random.Random(seed)
    parts, heads = ["ab", "abc", "bad", "Bed", "cab-d", "dea"], ["huis", "boom", "weg-dek", "straat", "kat"]
    recs = list({("_".join(r.choices(parts, k=r.randint(1, 3))), "_".join(r.choices(heads, k=r.randint(1, 2)))) for _ in range(40)})
    chained = spark.createDataFrame([(i, v, h) for i, (v, h) in enumerate(recs)], "pos bigint, variant string, head string")
    lexicon = spark.createDataFrame([("abc", 100), ("dea", 5)], "word string, freq bigint")
    got = [x.deleted for x in H.clean_chains(chained, lexicon, artifrq=100, low_length=4).orderBy("pos").collect()]
    assert got == brute_clean(recs, {"abc"}, 4)


@pytest.mark.parametrize("dense", [0, 400, 10**9])
def test_crowded_anagrams_keep_their_part_pairs(spark, dense, monkeypatch):
    monkeypatch.setattr(P, "DENSE", dense)
    r = random.Random(5)
    words = {f"{''.join(r.sample('abcde', 5))}_dede" for _ in range(40)} | {"abced_dead", "dede_abcde"}
    voc = spark.createDataFrame([(w, 1) for w in sorted(words)] + [("abcde_dede", 1000)], "word string, freq bigint")
    ana = G.anagram_table(voc, LETTERS)
    index = ana.select(F.lit(7).cast("bigint").alias("kwc"), "hash").distinct()
    got = P.find_pairs(index, ana, voc, artifrq=1000, distance=2, low_length=2)
    want, parts = brute_pairs({x.word: x.freq for x in voc.collect()}, [tuple(x) for x in index.collect()], [tuple(x) for x in ana.select("hash", "word").collect()], 1000, 2, 2)
    assert len(parts) > 20 and {(x.part1, x.part2): x.n for x in got.part_counts.collect()} == parts
    assert {(x.variant, x.candidate) for x in got.records.collect()} == set(want)


def test_lookups_of_hot_keys(spark, monkeypatch):
    from lexloom.operators import lookup as K

    left = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), ("b", "y")], "r string, w string")
    want = {how: sorted(map(str, K.lookup(left, "k", right, "r", how=how, hot=[]).collect())) for how in ("left", "inner", "left_semi", "left_anti")}
    monkeypatch.setattr(K, "HOT_ROWS", 5)
    assert K.hot_keys(left, "k") == ["a"]
    assert {how: sorted(map(str, K.lookup(left, "k", right, "r", how=how).collect())) for how in want} == want
