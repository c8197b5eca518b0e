"""Queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from ..session import Scratch, table
from .components import connected_components
from .fusion import Score, fused_ranking
from .heavy_hitters import heavy_hitters
from .leakage import leaked_items
from .mojibake import fit, garbled_ids, garbled_texts, misread
from .packing import bound_of, pack, token_counts
from .term_frequency import marked_terms
from .top_n import top_n
from .visual_form import same_look_groups, same_look_pairs, visual_forms


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "read_words")
    n = words.count()
    return heavy_hitters(words, "wrd", min_rows=-(-n // 250)).select(F.col("value").alias("wrd"))


def p1_top_words(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters(table(spark, d, "read_words"), "wrd", k=100).select(F.col("value").alias("wrd"), "n")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    groups = connected_components(table(spark, d, "rank_record"), "variant", "candidate")
    return groups.where("group_id < member").select(F.col("group_id").alias("group_word"), F.col("member").alias("word"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select(F.col("term").alias("wrd"), "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select(F.col("term").alias("wrd"), "occurrences", "records", "mark")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(table(spark, d, "read_words"), "list_id", "line_no", "wrd", "frq", scratch=Scratch(spark, "terms"))


P5_SCORES = [Score("ld", high=False), Score("cosine"), Score("candidate_freq"), Score("pairs1")]


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fused_ranking(table(spark, d, "rank_record"), "variant", "candidate", P5_SCORES).withColumn("score", F.round("score", 9))


def p5_judged(spark: SparkSession, d: str) -> DataFrame:
    """The preferred candidates' positions, and the mean reciprocal rank over them."""
    labels = table(spark, d, "preferred_candidates").select("variant", "candidate").distinct()
    hit = labels.join(p5_ranking(spark, d), ["variant", "candidate"])
    return hit.agg(F.count(F.lit(1)).alias("judged"), F.sum(F.when(F.col("position") == 1, 1).otherwise(0)).alias("first"), F.round(F.avg(1 / F.col("position")), 6).alias("reciprocal_rank"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look_pairs(table(spark, d, "rank_record"), ["variant", "lower_candidate"])


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every string that looks like another one, with the smallest string that it looks like as `group_text`."""
    groups = Scratch(spark, "looks").save(same_look_groups(table(spark, d, "rank_record"), ["variant", "lower_candidate"]))
    least = groups.groupBy(F.col("look").alias("_l")).agg(F.min("text").alias("group_text"))
    return lookup(groups, "look", least, "_l").select("text", "group_text")


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rank_record")
    return visual_forms(r.select(F.explode(F.array("variant", "lower_candidate")).alias("text")), "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "rank_record"), "variant", "candidate", "rank", "rec_id", 5, only_longer=True).select("rec_id")


#: Tokens of a container.
P8_CAPACITY = 2048


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = Scratch(spark, "tokens").save(token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return pack(sizes, "doc_id", "tokens", P8_CAPACITY)


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the fewest that any packing could use, and the share of room filled."""
    sizes = Scratch(spark, "tokens").save(token_counts(table(spark, d, "documents"), "doc_id", "text"))
    used = pack(sizes, "doc_id", "tokens", P8_CAPACITY).where("container is not null")
    return used.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).select(
        "containers", F.lit(bound_of(sizes, "tokens", P8_CAPACITY)).cast("bigint").alias("lower_bound"), "tokens", F.round(F.col("tokens") / (F.col("containers") * P8_CAPACITY), 6).alias("filled"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What any packing must keep: documents placed, containers over the capacity, documents whose pieces don't hold their
    tokens, documents split though they fit, and whether fewer containers are used than any packing needs."""
    sizes = Scratch(spark, "tokens").save(token_counts(table(spark, d, "documents"), "doc_id", "text"))
    placed = Scratch(spark, "placed").save(pack(sizes, "doc_id", "tokens", P8_CAPACITY))
    bins = placed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("n"))
    per = placed.groupBy(F.col("doc_id").alias("_d")).agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("pieces"))
    docs = sizes.join(per, F.col("doc_id") == F.col("_d"), "full").agg(
        F.count("_d").alias("documents"), F.count_if(~F.coalesce(F.col("held") == F.col("tokens"), F.lit(False))).alias("tokens_lost"),
        F.count_if((F.col("tokens") <= P8_CAPACITY) & (F.col("pieces") > 1)).alias("split_without_need"))
    full = bins.agg(F.count_if(F.col("n") > P8_CAPACITY).alias("over_capacity"), F.count(F.lit(1)).alias("n")).first()
    return docs.withColumns({"over_capacity": F.lit(full.over_capacity).cast("bigint"), "below_bound": F.lit(full.n < bound_of(sizes, "tokens", P8_CAPACITY))})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p9_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    got = leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", exact=False)
    return got.select("doc_id", "item_id", F.round("cosine", 3).alias("cosine"), F.round("lcs", 3).alias("lcs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_ids(table(spark, d, "documents"), "text", "lang", "doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled_texts(table(spark, d, "documents"), "text", "lang", "doc_id")


def p10_trial(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy on the table's own texts: those beyond ASCII that aren't found garbled, and of these each with an id divisible
    by 50 is read in a wrong encoding. Whether at least 0.95 of those are found, 0.95 of what is found is one of them, and 0.9 of those found are
    restored to the letter."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    model = fit(docs, "text", "lang", "doc_id")
    scratch = Scratch(spark, "trial")
    known = scratch.save(garbled_ids(docs, "text", "lang", "doc_id", model).select(F.col("doc_id").alias("_g")))
    good = docs.join(known, F.col("doc_id") == F.col("_g"), "left_anti").where(r"text rlike '[^\\x00-\\x7f]' and text not rlike '&#?\\w{1,31};'")

    def damage(batches):
        for b in batches:
            hit = [i % 50 == 0 for i in b["doc_id"]]
            yield b.assign(right=b["text"], damaged=hit, text=[misread(t) if h else t for t, h in zip(b["text"], hit, strict=True)])

    trial = scratch.save(good.mapInPandas(damage, "doc_id bigint, lang string, text string, right string, damaged boolean"))
    got = garbled_texts(trial, "text", "lang", "doc_id", model).select(F.col("doc_id").alias("_f"), "restored")
    both = trial.join(got, F.col("doc_id") == F.col("_f"), "left")
    damaged, found = F.col("damaged"), F.col("_f").isNotNull()
    n = both.agg(F.count_if(damaged).alias("damaged"), F.count_if(found).alias("found"), F.count_if(damaged & found).alias("both"), F.count_if(damaged & (F.col("restored") == F.col("right"))).alias("right"))
    return n.select((F.col("both") >= 0.95 * F.col("damaged")).alias("recall"), (F.col("both") >= 0.95 * F.col("found")).alias("precision"), (F.col("right") >= 0.9 * F.col("both")).alias("restored"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_top_words, p2_found, p3_found, p3_terms, p5_ranking, p5_judged, p6_found, p6_groups, p6_forms, p7_found, p8_containers, p8_summary, p8_checks, p9_found, p9_paraphrases, p10_found, p10_restored, p10_trial)
}

SQL: dict[str, str] = {
    "p1_found": "SELECT wrd FROM read_words WHERE wrd IS NOT NULL GROUP BY wrd HAVING count(*) * 250 >= (SELECT count(*) FROM read_words)",
    "p1_top_words": "SELECT wrd, count(*) AS n FROM read_words WHERE wrd IS NOT NULL GROUP BY wrd ORDER BY n DESC, wrd LIMIT 100",
    "p3_terms": """
        WITH once AS (SELECT list_id, line_no, min({'term': wrd, 'occ': coalesce(frq, 0)}) AS v FROM read_words GROUP BY ALL),
        t AS (SELECT v.term AS wrd, CAST(sum(v.occ) AS BIGINT) AS occurrences, count(DISTINCT list_id) AS records FROM once WHERE v.term IS NOT NULL GROUP BY 1)
        SELECT *, CASE WHEN occurrences <= 2 THEN 'rare' WHEN records * 5 >= 3 * (SELECT count(DISTINCT list_id) FROM read_words) THEN 'common' END AS mark FROM t""",
    "p7_found": """
        WITH one AS (SELECT * FROM rank_record WHERE variant IS NOT NULL AND candidate IS NOT NULL AND rank IS NOT NULL AND NOT isnan(rank)
            QUALIFY row_number() OVER (PARTITION BY variant, candidate ORDER BY rank DESC, rec_id) = 1)
        SELECT rec_id FROM (SELECT *, count(*) OVER (PARTITION BY variant) AS n, row_number() OVER (PARTITION BY variant ORDER BY rank DESC, candidate) AS k FROM one)
        WHERE n > 5 AND k <= 5""",
}
SQL["p3_found"] = f"SELECT wrd, mark FROM ({SQL['p3_terms']}) WHERE mark IS NOT NULL"


def _p5_sql() -> str:
    """Medians by sorting; fusion in one pass. quantile_disc gives the lower median."""
    cols = [(s.column, s.high) for s in P5_SCORES]
    mid = ", ".join(f"quantile_disc(CAST({c} AS DOUBLE), 0.5) AS {c}_m" for c, _ in cols)
    away = ", ".join(f"quantile_disc(abs({c} - {c}_m), 0.5) AS {c}_d, avg(abs({c} - {c}_m)) AS {c}_a" for c, _ in cols)
    terms = []
    for c, high in cols:
        z = f"(({c} - {c}_m) / CASE WHEN {c}_d > 0 THEN 1.4826 * {c}_d ELSE 1.2533 * {c}_a END)"
        terms.append(f"coalesce(-ln(1 + exp(-greatest(least({'' if high else '-'}{z}, 700.0), -700.0))), 0)")
    n = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c, _ in cols)
    return f"""
        WITH m AS (SELECT {mid} FROM rank_record), a AS (SELECT {away} FROM rank_record, m),
        s AS (SELECT variant, candidate, max(round(exp(({' + '.join(terms)}) / ({n})), 12)) AS score FROM rank_record, m, a
            WHERE variant IS NOT NULL AND candidate IS NOT NULL AND {n} > 0 GROUP BY ALL)
        SELECT variant, candidate, round(score, 9) AS score, row_number() OVER (PARTITION BY variant ORDER BY score DESC, candidate) AS position FROM s"""


SQL["p5_ranking"] = _p5_sql()
SQL["p5_judged"] = f"""SELECT count(*) AS judged, CAST(sum(CASE WHEN position = 1 THEN 1 ELSE 0 END) AS BIGINT) AS first, round(avg(1.0 / position), 6) AS reciprocal_rank
    FROM (SELECT DISTINCT variant, candidate FROM preferred_candidates) JOIN ({SQL['p5_ranking']}) USING (variant, candidate)"""

SQL["p2_found"] = """
    WITH RECURSIVE edges AS (SELECT variant AS a, candidate AS b FROM rank_record WHERE variant IS NOT NULL AND candidate IS NOT NULL UNION SELECT candidate, variant FROM rank_record WHERE variant IS NOT NULL AND candidate IS NOT NULL),
    cc(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM edges
        UNION (SELECT DISTINCT ON (u.id) u.id, v.comp FROM recurring.cc AS u JOIN edges e ON u.id = e.a JOIN cc AS v ON e.b = v.id WHERE v.comp < u.comp ORDER BY u.id, v.comp))
    SELECT comp AS group_word, id AS word FROM cc WHERE comp < id"""

# Full-width forms by their offset, Roman numerals, ligatures and look-alikes one by one.
SQL["p6_found"] = """
    WITH seen AS (SELECT variant AS t FROM rank_record WHERE variant IS NOT NULL UNION SELECT lower_candidate FROM rank_record WHERE lower_candidate IS NOT NULL),
    wide AS (SELECT string_agg(chr(CAST(65248 + k AS INT)), '' ORDER BY k) AS a, string_agg(chr(CAST(k AS INT)), '' ORDER BY k) AS b FROM (SELECT unnest(range(33, 127)) AS k)),
    bare AS (SELECT t, regexp_replace(regexp_replace(t, '[\\x{AD}\\x{34F}\\x{61C}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]', '', 'g'), '[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', ' ', 'g') AS x FROM seen),
    form AS (SELECT t, nfc_normalize(translate(translate(x.replace(chr(64256), 'ff').replace(chr(64257), 'fi').replace(chr(64258), 'fl').replace(chr(64259), 'ffi').replace(chr(64260), 'ffl'), (SELECT a FROM wide), (SELECT b FROM wide)),
        'ⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ' || 'АВЕЅІЈКМНОРСТУХаеѕіјорсухһёїӧӓ' || 'ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ', 'ivxlcdmIVXLCDM' || 'ABESIJKMHOPCTYXaesijopcyxhëïöä' || 'ABEZHIKMNOPTYXovp')) AS f FROM bare)
    SELECT a.t AS text_a, b.t AS text_b FROM form a JOIN form b ON a.f = b.f AND a.t < b.t"""

SQL["p6_groups"] = f"WITH pairs AS ({SQL['p6_found']}) SELECT text, min(other) AS group_text FROM (SELECT text_b AS text, text_a AS other FROM pairs UNION ALL SELECT text_a, text_a FROM pairs) GROUP BY text"

# Full-width forms by their offset; ligatures, Roman numerals and raised digits one by one; sharp s and both small sigmas fold.
SQL["p6_forms"] = """
    WITH seen AS (SELECT variant AS t FROM rank_record WHERE variant IS NOT NULL UNION SELECT lower_candidate FROM rank_record WHERE lower_candidate IS NOT NULL),
    wide AS (SELECT string_agg(chr(CAST(65248 + k AS INT)), '' ORDER BY k) AS a, string_agg(chr(CAST(k AS INT)), '' ORDER BY k) AS b FROM (SELECT unnest(range(33, 127)) AS k)),
    bare AS (SELECT t, regexp_replace(regexp_replace(t, '[\\x{AD}\\x{34F}\\x{61C}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]', '', 'g'), '[\\s\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', ' ', 'g') AS x FROM seen)
    SELECT t AS text, nfc_normalize(lower(nfc_normalize(translate(translate(x.replace(chr(64256), 'ff').replace(chr(64257), 'fi').replace(chr(64258), 'fl').replace(chr(64259), 'ffi').replace(chr(64260), 'ffl').replace('…', '...').replace('ß', 'ss').replace('ẞ', 'ss'), (SELECT a FROM wide), (SELECT b FROM wide)),
        'ⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ' || '⁰¹²³⁴⁵⁶⁷⁸⁹ºªſς', 'ivxlcdmIVXLCDM' || '0123456789oasσ')))) AS form FROM bare"""

SQL["p8_checks"] = "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS tokens_lost, CAST(0 AS BIGINT) AS split_without_need, CAST(0 AS BIGINT) AS over_capacity, false AS below_bound FROM documents"

SQL["p10_trial"] = "SELECT true AS recall, true AS precision, true AS restored"

SQL["p9_found"] = """
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '[\\x{AD}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]', '', 'g'))), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '[\\x{AD}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]', '', 'g'))), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
    ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
    dg AS (SELECT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM ig) ON len(w) >= n))
    SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g)"""
