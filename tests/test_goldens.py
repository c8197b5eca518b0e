"""Results against complete input and output files. Where they lie and how to read them is in the table of fixtures; without
the files the tests are skipped."""

import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import classify as C
from lexloom.operators import lexicon as L
from lexloom.operators import rank as R
from lexloom.sources import formats, sinks

TABLE = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text() if (Path(__file__).resolve().parents[1] / "FIXTURES.md").exists() else ""
ROOT = Path(m.group(1)) if (m := re.search(r"relative to `(/[^`]+)`", TABLE)) else Path("/nowhere")


def files(row: str) -> list[Path]:
    """The files that a row of the table names, in its order."""
    line = next((x for x in TABLE.splitlines() if x.startswith(f"| {row} |")), "")
    names = []
    for name in re.findall(r"`([\w./{},-]+)`", line):
        m = re.fullmatch(r"(.*)\{(.*)\}", name)
        names += [m.group(1) + x for x in m.group(2).split(",")] if m else [name]
    at = [ROOT / x if "/" in x else None for x in names]
    folder = next((x.parent for x in at if x is not None and x.exists()), ROOT)
    found = [x if x is not None else folder / n for x, n in zip(at, names, strict=True)]
    found = [x for x in found if x.is_file() and x.suffix not in (".sh", ".cxx")]
    if not found:
        pytest.skip("no fixture files")
    return found


def test_ngrams_of_lines(spark):
    text, *golds = files("n-grams")
    docs = formats.documents(spark, str(text))
    for n, gold in enumerate(golds, 1):
        want = dict(x.rsplit("\t", 1) for x in gold.read_text().splitlines())
        got = {r.word: str(r.freq) for r in L.word_count(docs, "text", n, per_line=True).collect()}
        assert got == want and len(want) > 15


def test_classes_of_a_vocabulary(spark):
    names = files("classify")
    pick = lambda end: next(x for x in names if x.name.endswith(end))
    chars = files("alphabet")[0]
    letters = [r.ch for r in formats.alphabet(formats.lines(spark, str(chars))).collect()]
    words = formats.foreground(formats.lines(spark, str(pick(".tsv"))).withColumn("value", formats.composed("value")))
    hemps = formats.hemps(formats.lines(spark, str(pick(".data"))))
    got = C.classify_lexicon(words, letters=C.both_cases("".join(letters)), acronyms=True, hemps=hemps)
    for name, second in (("clean", "freq"), ("unk", "freq"), ("punct", "form"), ("acro", "freq")):
        want = dict(x.split("\t") for x in pick(f".{name}").read_text().splitlines() if x)
        assert {r.word: str(r[second]) for r in got[name].collect()} == want and want, name


def test_scores_of_pairs(spark):
    pairs, gold = files("rank")[:2]
    records = formats.pairs(formats.lines(spark, str(pairs)))
    got = defaultdict(dict)
    for r in R.rank_pairs(records, clip=5, skip=(10, 11)).withColumn("text", sinks.score_text("score")).collect():
        got[r.variant][r.candidate] = (str(r.variant_freq), str(r.candidate_freq), str(r.kwc), str(r.ld), r.text)
    want = defaultdict(dict)
    for x in gold.read_text().splitlines():
        v, vf, c, cf, kwc, ld, score = x.split("#")
        want[v][c] = (vf, cf, kwc, ld, score)
    assert set(got) == set(want) and sum(map(len, want.values())) > 200
    for v, rows in want.items():
        assert sorted(x[-1] for x in got[v].values()) == sorted(x[-1] for x in rows.values()), v
        least = min(x[-1] for x in rows.values())  # of candidates that tie for the last place either may stay
        assert all(got[v].get(c) == x for c, x in rows.items() if x[-1] != least or c in got[v]), v


def test_values_of_foci(spark):
    listed = next(x for x in re.findall(r"`(tests/[\w/]+/foci)`", TABLE)) if "foci" in TABLE else ""
    if not (ROOT / listed).is_file():
        pytest.skip("no fixture files")
    letters = X.alphabet_values(formats.alphabet(formats.lines(spark, str(files("alphabet")[0]))).collect())
    rows = formats.anagrams(formats.lines(spark, str(ROOT / listed)))
    assert rows.where(X.anagram_hash("word", letters) != F.col("hash")).count() == 0 < rows.count()
