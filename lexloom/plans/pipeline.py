"""From texts or a vocabulary to ranked, chained and cleaned corrections. Each step writes the tables that later steps read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alphabet as A
from ..operators import anagram as G
from ..operators import chain as H
from ..operators import classify as C
from ..operators import lexicon as L
from ..operators import pairs as P
from ..operators import rank as R
from ..session import Scratch


@dataclass
class Pipeline:
    """Settings of a run; `modes` are the letters of the steps wanted, each with those it needs: a counts, b classifies,
    c anagrams, d index, e pairs, f ranks, chains and cleans. An alphabet that is built from the words has their characters of
    a frequency of `alphabet_clip` at least; the confusions of two grow with its fourth power, so a large one needs a clip."""

    spark: SparkSession
    distance: int = 2
    artifrq: int = 100_000_000
    clip: int = 1
    low_length: int = 5
    high_length: int = 35
    skip: tuple[int, ...] = ()
    acronyms: bool = False
    alphabet_clip: int = 1
    steps: dict[str, DataFrame] = field(default_factory=dict)

    def run(self, *, texts: DataFrame | None = None, text: str = "text", lexicon: DataFrame | None = None, background: DataFrame | None = None, alphabet: DataFrame | None = None, ngram: int = 1, classify: bool = True, modes: str = "abcdef",
            historical: DataFrame | None = None, diacritic: DataFrame | None = None, no_hld: bool = False, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
        """The tables of all steps by name. Words come from `texts` or from `lexicon` (word, freq); the alphabet (ch,
        freq, hash) is built from the words if it isn't given. Tables that several steps read are written once.
        `historical` and `diacritic` are confusions (kwc) that pairs are marked by, `no_hld` excuses historical pairs from the
        distance; `vectors` (word, vec) give the cosines for ranking."""
        scratch, out = Scratch(self.spark, "pipeline"), self.steps
        words = lexicon if lexicon is not None else L.word_count(texts, text, ngram)
        out["words"] = words = scratch.save(words.select("word", "freq"))
        if alphabet is None:
            alphabet = A.alphabet_build(A.char_count(words, "word"), clip=self.alphabet_clip, separator=X.SEPARATOR)
        rows = alphabet.collect()
        values, table = X.alphabet_values(rows), A.symbols(rows)
        letters = "".join(values)
        if "b" in modes and classify:
            tables = C.classify_lexicon(words, letters=C.both_cases(letters), background=background, artifrq=self.artifrq if background is not None else 0, acronyms=self.acronyms)
            out.update(tables)
            words = tables["clean"]
        out["clean"] = clean = scratch.save(words)
        if not set("cdef") & set(modes):
            return out
        out["anagrams"] = anagrams = scratch.save(G.anagram_table(clean, values))
        out["foci"] = foci = scratch.save(G.foci(clean, values, self.artifrq))
        if not set("def") & set(modes):
            return out
        out["confusions"] = confusions = scratch.save(A.confusions(self.spark, table, self.distance))
        keys = scratch.save(G.keys_in_band(anagrams, self.low_length, self.high_length))
        out["index"] = index = scratch.save(G.build_index(keys, table, self.distance, confusions, foci.select("hash")))
        if not set("ef") & set(modes):
            return out
        found = P.find_pairs(index, anagrams, clean, artifrq=self.artifrq, distance=self.distance, low_length=self.low_length, high_length=self.high_length, letters=letters,
                             historical=historical, diacritic=diacritic, no_hld=no_hld)
        out["pairs"], out["short"], out["ambiguous"] = scratch.save(found.records), found.short, found.ambiguous
        if "f" in modes:
            cosines = R.neighbour_cosines(vectors, out["pairs"]) if vectors is not None else None
            out["ranked"] = scratch.save(R.rank_pairs(out["pairs"], confusions=confusions, cosines=cosines, alphabet=values, clip=self.clip, skip=self.skip))
            chained = scratch.save(H.chain(out["ranked"], values).withColumn("pos", F.monotonically_increasing_id()))
            out["chained"] = chained.drop("pos")
            out["cleaned"] = H.clean_chains(chained, words, artifrq=self.artifrq, low_length=self.low_length)
        return out
