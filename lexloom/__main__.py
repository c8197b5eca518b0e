"""Command line: `python -m lexloom <step> [options] files`. Every step reads and writes the delimited text formats, as
folders of part files in order."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import alphabet as A
from .operators import anagram as G
from .operators import chain as H
from .operators import classify as C
from .operators import lexicon as L
from .operators import pairs as P
from .operators import rank as R
from .operators import vectors as V
from .session import Scratch, build_session, release
from .sources import formats, sinks


def _letters(spark: SparkSession, path: str) -> list:
    return formats.alphabet(formats.lines(spark, path)).collect()


def _lexicon(spark: SparkSession, path: str) -> DataFrame:
    return formats.lexicon(formats.lines(spark, path))


def lexstat(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    chars = A.char_count(_lexicon(spark, o.file[0]), "word")
    letters = A.alphabet_build(chars, clip=o.clip, separator=o.separator or None)
    rows = letters.collect()
    out = {"chars": sinks.alphabet(letters), "diac": sinks.confusions(A.diacritic_confusions(letters))}
    return out | ({"confusions": sinks.confusions(A.confusions(spark, A.symbols(rows), o.LD, all_examples=o.all))} if o.LD else {})


def stats(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    docs = formats.documents(spark, o.file, recursive=o.recursive, pattern=o.expr)
    if o.xml:
        docs = formats.xml_texts(docs, "file", "text")
    freqs = L.word_count(docs, "text", o.ngram, per_line=o.newline, lower=o.lower, separator=o.separator)
    freqs = L.clip(freqs, o.clip) if o.clip else freqs
    return {"wordfreq": sinks.wordfreq(L.with_running_totals(freqs) if o.percentage else freqs)}


def unk(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    letters = C.both_cases("".join(X.alphabet_values(_letters(spark, o.alph)))) if o.alph else ""
    words = formats.foreground(formats.lines(spark, o.file[0]).withColumn("value", formats.composed("value")))
    back = formats.background(formats.lines(spark, o.background), o.artifrq) if o.background else None
    hemps = formats.hemps(formats.lines(spark, o.hemp)) if o.hemp else None
    rules = X.DEFAULT_RULES
    if o.rules:
        with open(o.rules, encoding="utf-8") as f:
            rules = X.parse_rules(f.read())
    return sinks.classified(C.classify_lexicon(words, letters=letters, background=back, artifrq=o.artifrq, acronyms=o.acro, hemps=hemps, rules=rules))


def anahash(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    values, words = X.alphabet_values(_letters(spark, o.alph)), _lexicon(spark, o.file[0])
    if o.list:
        return {"list": sinks.hash_list(G.hash_list(words, values))}
    if o.background:
        words = G.merge_background(words, formats.background(formats.lines(spark, o.background), 1))
    foci = G.foci(words, values, o.artifrq, parts=o.ngrams, separator=o.separator)
    return {"anagrams": sinks.anagrams(G.anagram_table(words, values)), "foci": sinks.anagrams(foci)}


def indexer(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    scratch = Scratch(spark, "index")
    keys = scratch.save(G.keys_in_band(formats.anagrams(formats.lines(spark, o.hash)), o.low, o.high))
    foci = formats.foci(formats.lines(spark, o.foci)) if o.foci else None
    conf = scratch.save(formats.confusions(formats.lines(spark, o.charconf)))
    if foci is not None and o.step == "indexerNT":
        index = G.index_by_focus(keys, conf, foci)
    elif o.alph:
        index = G.build_index(keys, A.symbols(_letters(spark, o.alph)), o.LD, conf, foci)
    else:
        index = G.index_by_confusion(keys, conf, foci)
    index = scratch.save(index)
    return {"index": sinks.index(index)} | ({"confstats": sinks.confusion_stats(G.confusion_stats(index))} if o.confstats else {})


def ldcalc(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    flagged = lambda path: formats.flagged_confusions(formats.lines(spark, path)) if path else None
    got = P.find_pairs(formats.index(formats.lines(spark, o.index)), formats.anagrams(formats.lines(spark, o.hash)), formats.lexicon(formats.lines(spark, o.clean)), artifrq=o.artifrq, distance=o.LD,
                       low_length=o.low, high_length=o.high, letters="".join(X.alphabet_values(_letters(spark, o.alph))) if o.alph else "", historical=flagged(o.hist), diacritic=flagged(o.diac), no_hld=o.nohld)
    return {"ldcalc": sinks.pairs(got.records), "short": sinks.pairs(got.short), "ambi": sinks.ambiguous(got.ambiguous)}


def rank(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    records = Scratch(spark, "rank").save(formats.pairs(formats.lines(spark, o.file[0])))
    conf = formats.confusions(formats.lines(spark, o.charconf)) if o.charconf else None
    near = R.neighbour_cosines(formats.word_vectors(spark, o.wordvec), records) if o.wordvec else None
    skip = tuple(int(x) for x in o.skipcols.split(",") if x)
    got = R.rank_pairs(records, confusions=conf, alphabet=X.alphabet_values(_letters(spark, o.alph)), clip=o.clip, skip=skip, artifrq1=o.subtractartifrqfeature1, artifrq2=o.subtractartifrqfeature2, cosines=near, local_medians=o.ALTERNATIVE, debug=o.debug)
    return {"ranked": sinks.ranked(got, o.clip)} | ({"debug": sinks.ranked_debug(got)} if o.debug else {}) | ({"charconfreq": sinks.confusion_frequencies(R.confusion_frequencies(records, conf))} if conf is not None else {})


def chain(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    ranked = formats.ranked(formats.lines(spark, o.file[0])).withColumn("pos", F.monotonically_increasing_id())
    return {"chained": sinks.chained(H.chain(ranked, X.alphabet_values(_letters(spark, o.alph)), caseless=o.caseless, no_unknown=o.nounk))}


def chainclean(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    chained = Scratch(spark, "chained").save(formats.chained(formats.lines(spark, o.file[0])))
    got = Scratch(spark, "cleaned").save(H.clean_chains(chained, _lexicon(spark, o.lexicon), artifrq=o.artifrq, low_length=o.low, caseless=o.caseless))
    return {"cleaned": sinks.cleaned(got), "deleted": sinks.cleaned(got, deleted=True)}


def lexclean(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    clean, dirty = L.lexclean(formats.tagged_lexicon(formats.lines(spark, o.file[0])), "".join(X.alphabet_values(_letters(spark, o.alph))), reverse=o.reverse, tagged=o.tagged)
    return {"cleaned": sinks.wordfreq_clean(clean), "dirty": sinks.quarantine(dirty)}


def mergelex(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    rows = formats.lexicon(formats.lines(spark, o.file, recursive=o.recursive, pattern=o.expr))
    return {"merged": sinks.wordfreq(L.merge_lexicons(rows))}


def _asked(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return formats.lines(spark, o.file[0]).select(F.monotonically_increasing_id().alias("qid"), X.tokens("value").alias("words")).where(F.size("words") > 0)


def near(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    find = V.analogies if o.step == "analogy" else V.nearest
    got = find(formats.word_vectors(spark, o.vectors), _asked(spark, o), o.clip)
    return {"near": got.orderBy("qid", "position").select(F.concat_ws("\t", F.col("qid").cast("string"), "word", F.col("similarity").cast("string")).alias("value"))}


def dist(spark: SparkSession, o: argparse.Namespace) -> dict[str, DataFrame]:
    """Word pairs parted by a tab or `#`."""
    f = F.split("value", "[\t#]")
    pairs = formats.lines(spark, o.file[0]).where(F.size(f) == 2).select(F.get(f, F.lit(0)).alias("a"), F.get(f, F.lit(1)).alias("b"))
    got, cols = V.cosine_pairs(formats.word_vectors(spark, o.vectors), pairs), ["a", "b"]
    if o.freqs:
        got, cols = V.pair_frequencies(got, formats.word_frequencies(formats.lines(spark, o.freqs))), ["a", F.col("freq_a").cast("string"), "b", F.col("freq_b").cast("string")]
    return {"dist": got.select(F.concat_ws("\t", *cols, F.coalesce(F.col("cosine").cast("string"), F.lit("UNKNOWN word(s)"))).alias("value"))}


#: Step -> what it runs, and its options with their defaults (a type is an option without one).
STEPS = {
    "lexstat": (lexstat, {"clip": 0, "LD": 2, "separator": "_", "all": False}),
    "stats": (stats, {"ngram": 1, "clip": 0, "lower": False, "newline": False, "separator": "_", "xml": False, "percentage": False, "recursive": False, "expr": str}),
    "unk": (unk, {"alph": str, "background": str, "artifrq": 0, "acro": False, "hemp": str, "rules": str}),
    "anahash": (anahash, {"alph": str, "artifrq": 100_000_000, "background": str, "list": False, "ngrams": False, "separator": "_"}),
    "indexer": (indexer, {"hash": str, "charconf": str, "foci": str, "alph": str, "LD": 2, "low": 5, "high": 35, "confstats": False}),
    "indexerNT": (indexer, {"hash": str, "charconf": str, "foci": str, "alph": str, "LD": 2, "low": 5, "high": 35, "confstats": False}),
    "ldcalc": (ldcalc, {"index": str, "hash": str, "clean": str, "alph": str, "hist": str, "diac": str, "nohld": False, "LD": 2, "artifrq": 100_000_000, "low": 5, "high": 35}),
    "rank": (rank, {"alph": str, "charconf": str, "clip": 0, "skipcols": "", "subtractartifrqfeature1": 0, "subtractartifrqfeature2": 0, "wordvec": str, "ALTERNATIVE": False, "debug": False}),
    "chain": (chain, {"alph": str, "caseless": False, "nounk": False}),
    "chainclean": (chainclean, {"lexicon": str, "artifrq": 100_000_000, "low": 5, "caseless": False}),
    "lexclean": (lexclean, {"alph": str, "reverse": False, "tagged": False}),
    "mergelex": (mergelex, {"recursive": False, "expr": str}),
    "near": (near, {"vectors": str, "clip": 20}),
    "analogy": (near, {"vectors": str, "clip": 40}),
    "dist": (dist, {"vectors": str, "freqs": str}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexloom", description=__doc__)
    steps = top.add_subparsers(dest="step", required=True)
    for name, (_, options) in STEPS.items():
        p = steps.add_parser(name)
        p.add_argument("-o", "--out", required=True, help="a folder is written for each table, as <out>.<table>")
        p.add_argument("file", nargs="*")
        for option, default in options.items():
            if default is False:
                p.add_argument(f"--{option}", action="store_true")
            else:
                p.add_argument(f"--{option}", type=default if isinstance(default, type) else type(default), default=None if isinstance(default, type) else default)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(args)
    spark = spark or SparkSession.getActiveSession() or build_session()
    for name, values in STEPS[o.step][0](spark, o).items():
        sinks.write(values, f"{o.out}.{name}", mode="overwrite")
    release()


if __name__ == "__main__":
    main()
