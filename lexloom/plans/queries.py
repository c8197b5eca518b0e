"""Queries of the core operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

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
from ..operators import vectors as V
from ..session import Scratch, table
from ..sources import formats, sinks
from ..sources.raw_records import Field, load_records
from ..streaming.word_count import stream_word_count as stream_counts
from . import tables as T
from .pipeline import Pipeline
from .sql import SQL as SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# Rows that fail to parse

ALPHABET_FIELDS = [Field("ch", "char"), Field("freq", "number"), Field("hash", "number")]
BACKGROUND_FIELDS = [Field("word", "word"), Field("freq", "number")]


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = load_records(table(spark, d, "fillalphabet").select("line_id", "line"), "line", ALPHABET_FIELDS, comment="#")
    b = load_records(table(spark, d, "read_backgound").select("line_id", "line"), "line", BACKGROUND_FIELDS, least=1)
    return a, b


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = _raw(spark, d)
    return a.where("_reason is not null").select(F.lit("fillalphabet").alias("src"), "line_id").unionByName(
        b.where("_reason is not null").select(F.lit("read_backgound").alias("src"), "line_id"))


@query
def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    a, b = _raw(spark, d)
    keep = ["line_id", "_reason", "_offset"]
    return a.select(F.lit("fillalphabet").alias("src"), *keep).unionByName(b.select(F.lit("read_backgound").alias("src"), *keep)).where("_reason is not null").select(
        "src", "line_id", F.col("_reason").alias("reason"), F.col("_offset").alias("at_byte"))


@query
def p4_alphabet(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d)[0].where("_reason is null").select("line_id", "ch", "freq", "hash")


@query
def p4_background(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d)[1].where("_reason is null").select("line_id", "word", "freq")


# Frequency tables


@query
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return L.word_count(table(spark, d, "documents"), "text")


@query
def word_count_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return L.word_count(table(spark, d, "documents"), "text", 2, lower=True)


@query
def word_count_line_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return L.word_count(table(spark, d, "documents"), "text", 3, per_line=True)


@query
def stream_word_count(spark: SparkSession, d: str) -> DataFrame:
    """The same counts from a stream of the table's files."""
    schema = spark.read.parquet(f"{d}/documents.parquet").select("text").schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    is_dir = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema)
    texts = reader.parquet(f"{d}/documents.parquet") if is_dir else reader.option("pathGlobFilter", "documents.parquet").parquet(d)
    scratch = Scratch(spark, "stream")
    run = stream_counts(texts, "text").writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{scratch.root}/state")
    run.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{scratch.root}/counts")).start().awaitTermination()
    return spark.read.schema("word string, freq bigint").parquet(f"{scratch.root}/counts")


@query
def emphasis_runs(spark: SparkSession, d: str) -> DataFrame:
    return L.emphasis_runs(table(spark, d, "documents"), "text", "doc_id")


@query
def emphasis_runs_spaced(spark: SparkSession, d: str) -> DataFrame:
    """The runs of words that are written with spaces between all their characters."""
    spaced = table(spark, d, "read_words").select("row_id", F.array_join(F.split("wrd", ""), " ").alias("text"))
    return L.emphasis_runs(spaced, "text", "row_id")


@query
def xml_text_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The text nodes of documents put into XML, a node for each line."""
    t = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}\r]", "")
    t = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<d><p>"), F.replace(t, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></d>"))
    return formats.xml_texts(table(spark, d, "documents").select("doc_id", xml.alias("xml")), "doc_id", "xml")


@query
def wordfreq_totals(spark: SparkSession, d: str) -> DataFrame:
    return L.with_running_totals(T.word_list(spark, d)).withColumn("pct", F.round("pct", 6))


@query
def wordfreq_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.summary(T.word_list(spark, d)).select("tokens", "types", F.round("ttr", 9).alias("ttr"), F.round("angle", 6).alias("angle"))


@query
def wordfreq_clip(spark: SparkSession, d: str) -> DataFrame:
    return L.clip(T.word_list(spark, d), 5)


@query
def merge_lexicons(spark: SparkSession, d: str) -> DataFrame:
    return L.merge_lexicons(T.word_list(spark, d), T.vocabulary(spark, d))


@query
def lexicon_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return L.last_wins(table(spark, d, "read_words"), "wrd", "frq", "row_id")


@query
def lexclean_clean(spark: SparkSession, d: str) -> DataFrame:
    return L.lexclean(T.word_list(spark, d), "".join(T.letters(spark, d)))[0]


@query
def lexclean_dirty(spark: SparkSession, d: str) -> DataFrame:
    return L.lexclean(T.word_list(spark, d), "".join(T.letters(spark, d)))[1]


@query
def lexclean_reverse(spark: SparkSession, d: str) -> DataFrame:
    return L.lexclean(T.word_list(spark, d), "".join(T.letters(spark, d)), reverse=True)[0]


@query
def length_band(spark: SparkSession, d: str) -> DataFrame:
    return L.length_band(T.word_list(spark, d), "word", 5, 35)


# Alphabets and confusions


@query
def char_count(spark: SparkSession, d: str) -> DataFrame:
    return A.char_count(table(spark, d, "read_words").select("wrd"), "wrd")


@query
def alphabet_build(spark: SparkSession, d: str) -> DataFrame:
    return A.alphabet_build(A.char_count(table(spark, d, "read_words").select("wrd"), "wrd"), clip=20, separator="_")


@query
def alphabet_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.alphabet(table(spark, d, "fillalphabet").select(F.regexp_replace("line", "\r", "").alias("value")), 100)


@query
def confusions_ld1(spark: SparkSession, d: str) -> DataFrame:
    return A.confusions(spark, T.symbols(spark, d), 1)


@query
def confusions_ld2(spark: SparkSession, d: str) -> DataFrame:
    return A.confusions(spark, T.symbols(spark, d), 2)


@query
def confusions_all_examples(spark: SparkSession, d: str) -> DataFrame:
    return A.confusions(spark, T.symbols(spark, d), 1, all_examples=True).select("kwc", F.array_join("examples", "#").alias("examples"))


@query
def diacritic_confusions(spark: SparkSession, d: str) -> DataFrame:
    return A.diacritic_confusions(table(spark, d, "alphabet"))


# Functions


@query
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    w = T.word_list(spark, d).select("word")
    return w.select("word", X.is_roman("word").alias("roman"), X.is_dotted_acronym("word").alias("dotted"), X.filter_punct("word").alias("no_punct"), X.filter_tilde_hash("word").alias("no_tilde"),
                    X.strip_edges("word").alias("stripped"), X.transliterate("word").alias("plain"), F.array_join(X.split_parts("word"), "|").alias("parts"), F.array_join(X.plain_parts("word", "[_-]"), "|").alias("dash_parts"))


@query
def accents_stripped(spark: SparkSession, d: str) -> DataFrame:
    return T.vocabulary(spark, d).select("word", A.strip_accents(F.col("word")).alias("plain"))


@query
def fifth_powers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.fifth_power(F.pmod("p_partkey", F.lit(3000))).alias("fifth"))


@query
def pair_distances(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rank_record").where("variant is not null and candidate is not null")
    a, b = F.lower("variant"), F.lower("candidate")
    return r.select("rec_id", X.edit_distance("variant", "candidate", True).alias("caseless_ld"), (F.greatest(F.length(a), F.length(b)) - X.edit_distance("variant", "candidate", True)).alias("cls"))


# Classification


@query
def word_classes(spark: SparkSession, d: str) -> DataFrame:
    return C.with_part_class(T.word_list(spark, d).select("word"), "word", C.both_cases("".join(T.letters(spark, d))))


@query
def word_classes_general(spark: SparkSession, d: str) -> DataFrame:
    return C.with_word_class(T.word_list(spark, d).select("word"), "word", "cls")


def _classified(spark: SparkSession, d: str, background: bool = False) -> dict[str, DataFrame]:
    letters = C.both_cases("".join(T.letters(spark, d)))
    back = T.vocabulary(spark, d).where(F.col("freq") >= T.ARTIFRQ) if background else None
    return C.classify_lexicon(T.word_list(spark, d), letters=letters, background=back, artifrq=T.ARTIFRQ if background else 0, acronyms=True)


@query
def classify_clean(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)["clean"]


@query
def classify_unk(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)["unk"]


@query
def classify_punct(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)["punct"]


@query
def classify_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)["acro"]


@query
def classify_made_acronyms(spark: SparkSession, d: str) -> DataFrame:
    """Of words in capitals behind an article, and of the same with a dot after each letter."""
    w = table(spark, d, "read_words").where("wrd rlike '^[a-z]+$'")
    made = F.explode(F.array(F.concat(F.lit("de_"), F.upper("wrd")), F.concat(F.array_join(X.chars(F.upper("wrd")), "."), F.lit("."))))
    words = w.select(made.alias("word"), "frq").groupBy("word").agg(F.coalesce(F.sum("frq"), F.lit(0)).alias("freq"))
    return C.classify_lexicon(words, letters=C.both_cases("".join(T.letters(spark, d))), acronyms=True)["acro"]


@query
def classify_with_background(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, True)["clean"]


@query
def classify_foreground(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, True)["fore"]


# Anagrams and the index


@query
def hash_list(spark: SparkSession, d: str) -> DataFrame:
    return G.hash_list(T.vocabulary(spark, d), T.letters(spark, d))


@query
def anagram_table(spark: SparkSession, d: str) -> DataFrame:
    return G.anagram_table(T.vocabulary(spark, d), T.letters(spark, d))


@query
def anagram_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.anagrams(anagram_table(spark, d))


@query
def background_merge(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_background(T.word_list(spark, d), T.vocabulary(spark, d))


@query
def foci(spark: SparkSession, d: str) -> DataFrame:
    return G.foci(T.vocabulary(spark, d), T.letters(spark, d), T.ARTIFRQ)


@query
def foci_of_parts(spark: SparkSession, d: str) -> DataFrame:
    grams = L.word_count(table(spark, d, "documents"), "text", 2, per_line=True).unionByName(L.word_count(table(spark, d, "documents"), "text"))
    return G.foci(grams, T.letters(spark, d), 50, parts=True)


@query
def anagram_keys(spark: SparkSession, d: str) -> DataFrame:
    return G.keys_in_band(anagram_table(spark, d))


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "keys")
    anagrams = scratch.save(anagram_table(spark, d))
    return anagrams, scratch.save(G.keys_in_band(anagrams))


@query
def index_confusion_driven(spark: SparkSession, d: str) -> DataFrame:
    return G.index_by_confusion(_keys(spark, d)[1], confusions_ld1(spark, d))


@query
def index_met_in_the_middle(spark: SparkSession, d: str) -> DataFrame:
    return G.index_by_difference(_keys(spark, d)[1], T.symbols(spark, d), 1)


@query
def index_focus_driven(spark: SparkSession, d: str) -> DataFrame:
    return G.index_by_focus(_keys(spark, d)[1], confusions_ld1(spark, d), foci(spark, d).select("hash"))


@query
def index_ld2_of_foci(spark: SparkSession, d: str) -> DataFrame:
    return G.index_by_difference(_keys(spark, d)[1], T.symbols(spark, d), 2, foci(spark, d).select("hash"))


@query
def index_chosen(spark: SparkSession, d: str) -> DataFrame:
    return G.build_index(_keys(spark, d)[1], T.symbols(spark, d), 1, confusions_ld1(spark, d))


@query
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.confusion_stats(index_met_in_the_middle(spark, d))


# Pairs


def _pairs(spark: SparkSession, d: str, distance: int = 1) -> P.Pairs:
    scratch = Scratch(spark, "pairs")
    anagrams, keys = _keys(spark, d)
    index = scratch.save(G.index_by_difference(keys, T.symbols(spark, d), distance))
    return P.find_pairs(index, anagrams, T.vocabulary(spark, d), artifrq=T.ARTIFRQ, distance=distance, letters="")


@query
def low_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return P.low_frequencies(T.vocabulary(spark, d), T.ARTIFRQ)


@query
def pairs_ld1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).records


@query
def pairs_ld2(spark: SparkSession, d: str) -> DataFrame:
    """With transpositions."""
    return _pairs(spark, d, 2).records


#: Letters that older spelling has for one another.
HISTORICAL = ("sz", "iy", "ck", "uv", "fv")


def _historical(spark: SparkSession, letters: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(abs(letters[a] - letters[b]),) for a, b in HISTORICAL if a in letters and b in letters], "kwc bigint")


def _marked(spark: SparkSession, d: str, no_hld: bool) -> DataFrame:
    letters = T.letters(spark, d)
    anagrams, keys = _keys(spark, d)
    index = Scratch(spark, "pairs").save(G.index_by_difference(keys, T.symbols(spark, d), 1))
    return P.find_pairs(index, anagrams, T.vocabulary(spark, d), artifrq=T.ARTIFRQ, distance=1, letters="".join(letters), historical=_historical(spark, letters),
                        diacritic=A.diacritic_confusions(table(spark, d, "alphabet")), no_hld=no_hld).records


@query
def pairs_marked(spark: SparkSession, d: str) -> DataFrame:
    """With historical and diacritic confusions, and candidates in the alphabet only."""
    return _marked(spark, d, False)


@query
def pairs_historical_any_distance(spark: SparkSession, d: str) -> DataFrame:
    """The same, historical confusions being excused from the distance."""
    return _marked(spark, d, True)


def _ngram_pairs(spark: SparkSession, d: str) -> P.Pairs:
    """Pairs over the words and bigrams of the documents' lines; words of 50 and more occurrences are lexical."""
    docs = table(spark, d, "documents")
    freqs = L.word_count(docs, "text", 1).unionByName(L.word_count(docs, "text", 2, per_line=True))
    return P.find_near_pairs(freqs, T.letters(spark, d), T.symbols(spark, d), artifrq=50)


@query
def ngram_part_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ngram_pairs(spark, d).part_counts


@query
def ngram_short_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _ngram_pairs(spark, d).short


@query
def ngram_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    a = _ngram_pairs(spark, d).ambiguous
    return a.select("pair", F.array_join("ngram_pairs", "#").alias("ngram_pairs"))


# Ranking


@query
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.confusion_counts(T.records(spark, d))


@query
def confusion_medians(spark: SparkSession, d: str) -> DataFrame:
    return R.integer_median(T.records(spark, d), ["kwc"], "candidate_freq")


@query
def confusion_medians_local(spark: SparkSession, d: str) -> DataFrame:
    return R.integer_median(T.records(spark, d), ["variant", "kwc"], "candidate_freq")


@query
def confusion_complements(spark: SparkSession, d: str) -> DataFrame:
    return R.complement_counts(R.confusion_counts(T.records(spark, d)), confusions_ld2(spark, d), T.letters(spark, d))


@query
def confusion_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return R.confusion_frequencies(T.records(spark, d), confusions_ld2(spark, d))


@query
def ngram_evidence_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.drop_weak_ngrams(T.records(spark, d)).select("variant", "candidate")


@query
def feature_ranks(spark: SparkSession, d: str) -> DataFrame:
    got = R.rank_pairs(T.records(spark, d), clip=1_000_000_000, artifrq1=T.ARTIFRQ, artifrq2=T.ARTIFRQ, debug=True)
    return got.select("variant", "candidate", *[f"{c}_rank" for c in R.FEATURES], "rank_sum", F.round("score", 9).alias("score"))


def _ranked(spark: SparkSession, d: str, **options) -> DataFrame:
    return R.rank_pairs(T.records(spark, d), **options).withColumn("score", F.round("score", 9))


@query
def rank_best(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, clip=1)


@query
def rank_top5(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, clip=5, skip=(10, 11))


@query
def rank_local_medians(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, clip=3, local_medians=True)


@query
def rank_with_complements(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, clip=5, confusions=confusions_ld2(spark, d), alphabet=T.letters(spark, d))


# Chains


def _rising(spark: SparkSession, d: str) -> DataFrame:
    """Ranked records whose candidate is more frequent than the variant over the whole vocabulary, so chains end."""
    voc = T.vocabulary(spark, d)
    r = R.rank_pairs(T.records(spark, d), clip=1_000_000_000)
    r = r.join(voc.select(F.col("word").alias("variant"), F.col("freq").alias("vf")), "variant").join(voc.select(F.col("word").alias("candidate"), F.col("freq").alias("cf")), "candidate")
    return r.where("cf > vf").select("variant", F.col("vf").alias("variant_freq"), "candidate", F.col("cf").alias("candidate_freq"), "kwc", "ld", "score")


@query
def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    return H.first_candidates(_rising(spark, d)).select("variant", "candidate")


@query
def chain(spark: SparkSession, d: str) -> DataFrame:
    return H.chain(_rising(spark, d), T.letters(spark, d), caseless=True)


@query
def chain_cased(spark: SparkSession, d: str) -> DataFrame:
    return H.chain(_rising(spark, d), T.letters(spark, d), no_unknown=True)


@query
def chain_clean(spark: SparkSession, d: str) -> DataFrame:
    """Chains of the n-gram pairs of the documents, with the records deleted. Pairs lead to the more frequent word in lower
    case, of equals to the smaller value, so chains end without leaving ties out."""
    found = Scratch(spark, "found").save(_ngram_pairs(spark, d).records)
    kept = R.rank_pairs(found, clip=1)
    chained = Scratch(spark, "chained").save(H.chain(kept, T.letters(spark, d)).withColumn("pos", F.monotonically_increasing_id()))
    docs = table(spark, d, "documents")
    return H.clean_chains(chained, L.word_count(docs, "text"), artifrq=50).select("variant", "head", "deleted")


# Vectors


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))


@query
def vectors_nearest(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    asked = v.where("word % 50 = 0").select(F.col("word").alias("qid"), F.array("word").alias("words"))
    return V.nearest(v, asked, 20).withColumn("similarity", F.round("similarity", 5))


@query
def vectors_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return V.cosine_pairs(v, v.select(F.col("word").alias("a"), (F.col("word") + 1).alias("b"))).withColumn("cosine", F.round("cosine", 5))


@query
def vectors_analogy(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    w = F.col("word")
    asked = v.where("word % 50 = 0").select(w.alias("qid"), F.array(w, w + 1, w + 2).alias("words"))
    return V.analogies(v, asked, 40).withColumn("similarity", F.round("similarity", 5))


@query
def vectors_pair_freqs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the frequencies of both, taken from the word rows of the same number."""
    v, w = _vectors(spark, d), table(spark, d, "read_words")
    return V.pair_frequencies(v.select(F.col("word").alias("a"), (F.col("word") + 1).alias("b")), w.select(F.col("row_id").alias("word"), F.col("frq").alias("freq")))


@query
def vectors_neighbour_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Similarities for ranking of every fiftieth word and the hundred words after it."""
    v = _vectors(spark, d)
    records = v.where("word % 50 = 0").select(F.col("word").alias("variant"), F.explode(F.sequence(F.col("word") + 1, F.col("word") + 100)).alias("candidate"))
    return R.neighbour_cosines(v, records).withColumn("cosine", F.round("cosine", 5))


# File formats


@query
def wordfreq_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.wordfreq(wordfreq_clip(spark, d))


@query
def alphabet_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.alphabet(alphabet_build(spark, d))


@query
def confusion_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.confusions(confusions_ld1(spark, d))


@query
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.index(index_chosen(spark, d))


@query
def pairs_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.pairs(pairs_ld1(spark, d))


@query
def ranked_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ranked(rank_best(spark, d), clip=1)


@query
def chained_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.chained(chain(spark, d))


@query
def charconfreq_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.confusion_frequencies(confusion_frequencies(spark, d))


@query
def quarantine_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.quarantine(lexclean_dirty(spark, d))


@query
def wordfreq_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.wordfreq_clean(lexclean_clean(spark, d))


@query
def hash_list_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.hash_list(hash_list(spark, d))


@query
def confstats_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.confusion_stats(index_stats(spark, d))


@query
def punct_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.classified(_classified(spark, d))["punct"]


@query
def ambiguous_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ambiguous(_ngram_pairs(spark, d).ambiguous)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines of word lists, faulty ones included."""
    return table(spark, d, "read_backgound").select(F.col("line").alias("value"))


@query
def foreground_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.foreground(_lines(spark, d)).drop("pos")


@query
def background_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.background(_lines(spark, d), T.ARTIFRQ).drop("pos")


@query
def lexicon_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.lexicon(_lines(spark, d))


@query
def tagged_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.tagged_lexicon(_lines(spark, d))


@query
def frequencies_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.word_frequencies(_lines(spark, d)).drop("pos")


@query
def hemps_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.hemps(_lines(spark, d))


@query
def foci_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.foci(anagram_lines(spark, d))


@query
def anagrams_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.anagrams(anagram_lines(spark, d))


@query
def confusions_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.confusions(confusion_lines(spark, d))


@query
def flagged_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.flagged_confusions(confusion_lines(spark, d))


@query
def index_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.index(index_lines(spark, d))


@query
def pairs_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.pairs(pairs_lines(spark, d))


@query
def ranked_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.ranked(ranked_lines(spark, d))


@query
def chained_reader(spark: SparkSession, d: str) -> DataFrame:
    return formats.chained(chained_lines(spark, d)).drop("pos")


# The pipeline


def flagship(spark: SparkSession, d: str) -> DataFrame:
    run = Pipeline(spark, distance=1, artifrq=T.ARTIFRQ, clip=1)
    return run.run(lexicon=T.vocabulary(spark, d), alphabet=table(spark, d, "alphabet"), classify=False)["ranked"]


@query
def pipeline_ranked(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d).withColumn("score", F.round("score", 9))


@query
def pipeline_chained(spark: SparkSession, d: str) -> DataFrame:
    run = Pipeline(spark, distance=1, artifrq=T.ARTIFRQ, clip=1)
    return run.run(lexicon=T.vocabulary(spark, d), alphabet=table(spark, d, "alphabet"), classify=False)["chained"]


def _from_documents(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All steps at their default distance 2: words counted from the texts, classified beside the lexical words, pairs
    marked by historical and diacritic confusions, ranked, chained and cleaned."""
    back = T.vocabulary(spark, d).where(F.col("freq") >= T.ARTIFRQ)
    return Pipeline(spark, artifrq=T.ARTIFRQ).run(texts=table(spark, d, "documents"), background=back, alphabet=table(spark, d, "alphabet"), historical=_historical(spark, T.letters(spark, d)),
                                                  diacritic=A.diacritic_confusions(table(spark, d, "alphabet")))


@query
def pipeline_documents_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _from_documents(spark, d)["ranked"].withColumn("score", F.round("score", 9))


@query
def pipeline_documents_chained(spark: SparkSession, d: str) -> DataFrame:
    return _from_documents(spark, d)["chained"]


@query
def pipeline_documents_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _from_documents(spark, d)["cleaned"].select("variant", "head", "deleted")
