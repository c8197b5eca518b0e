"""The queries in SQL, as independent statements of what they must give."""

from __future__ import annotations

# Building blocks: common table expressions.
_BLANK = r"[\s\x0b\p{Z}\x1c-\x1f\x{85}]"
_EDGE = r"[\s\x0b\p{Z}\x1c-\x1f\x{85}_^<>\p{Pc}\p{Po}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\x{58A}\x{5BE}\x{1400}\x{1806}\x{2010}-\x{2015}\x{2E17}\x{2E1A}\x{2E3A}\x{2E3B}\x{2E40}\x{301C}\x{3030}\x{30A0}\x{FE31}\x{FE32}\x{FE58}\x{FE63}\x{FF0D}\p{S}\p{No}\p{Cf}\p{Mn}\p{Cc}]"
_LIST = "list AS (SELECT wrd AS word, CAST(coalesce(sum(frq), 0) AS BIGINT) AS freq FROM read_words WHERE wrd IS NOT NULL GROUP BY 1)"
_VOC = """voc AS (SELECT word, max(coalesce(freq, 0)) AS freq FROM (SELECT variant AS word, variant_freq AS freq FROM rank_record
    UNION ALL SELECT candidate, candidate_freq FROM rank_record) WHERE word IS NOT NULL GROUP BY 1)"""
_LETTERS = "letters AS (SELECT ch, hash FROM alphabet WHERE ch NOT IN ('*', '$'))"
_ABC = "(SELECT string_agg(ch, '') FROM alphabet WHERE ch NOT IN ('*', '$'))"


def _hashes(source: str, name: str = "hs") -> str:
    """(word, hash) of the distinct words of a relation."""
    return rf"""{name} AS (SELECT word, CAST(sum(CASE WHEN c IS NULL THEN 0 WHEN a.hash IS NOT NULL THEN a.hash WHEN regexp_matches(c, '{_BLANK}') OR regexp_matches(c, '\p{{P}}') THEN 0 ELSE 10510100501 END)
        + max(CASE WHEN a.hash IS NULL AND regexp_matches(coalesce(c, ''), '\p{{P}}') THEN 10000000000 ELSE 0 END) AS BIGINT) AS hash
        FROM (SELECT word, unnest(CASE WHEN word = '' THEN [NULL] ELSE string_split(lower(word), '') END) AS c FROM (SELECT DISTINCT word FROM {source})) LEFT JOIN letters a ON a.ch = c GROUP BY word)"""


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_BLANK}+'), lambda x: x <> '')"


_SYMBOLS = "sym AS (SELECT ch AS s, hash AS v FROM alphabet)"
_SETS1 = "sets AS (SELECT 0 AS n, '' AS s, 0 AS v UNION ALL SELECT 1, s, v FROM sym)"
_SETS2 = "sets AS (SELECT 0 AS n, '' AS s, 0 AS v UNION ALL SELECT 1, s, v FROM sym UNION ALL SELECT 2, a.s || b.s, a.v + b.v FROM sym a JOIN sym b ON a.v <= b.v)"
_DIFFS = """diffs AS (SELECT a.v - b.v AS kwc, a.n + b.n AS n, a.s || '~' || b.s AS example FROM sets a JOIN sets b ON a.v > b.v
    WHERE NOT list_has_any(string_split(a.s, ''), list_filter(string_split(b.s, ''), lambda x: x <> '')))"""
_FIRST = "conf AS (SELECT kwc, min({'n': n, 'e': example}).e AS example FROM diffs GROUP BY kwc)"
_CONF1 = f"{_SYMBOLS}, {_SETS1}, {_DIFFS}, {_FIRST}"
_CONF2 = f"{_SYMBOLS}, {_SETS2}, {_DIFFS}, {_FIRST}"

_ANA = f"{_VOC}, tame AS (SELECT DISTINCT translate(word, '~#', '__') AS word FROM voc WHERE word <> ''), {_LETTERS}, {_hashes('tame')}, ana AS (SELECT hash, word FROM hs WHERE hash > 0)"
_KEYS = "keys AS (SELECT hash FROM ana GROUP BY hash HAVING length(min(word)) BETWEEN 5 AND 35)"
_IDX = "idx AS (SELECT c.kwc, k.hash FROM keys k CROSS JOIN (SELECT DISTINCT kwc FROM conf) c JOIN keys u ON u.hash = k.hash + c.kwc)"
_FOCI = f"""low AS (SELECT DISTINCT word FROM voc WHERE freq >= 100000000), weak AS (SELECT lower(word) AS word, word AS raw FROM voc WHERE freq < 100000000 AND lower(word) NOT IN (SELECT word FROM low)),
    {_hashes('(SELECT raw AS word FROM weak)', 'wh')}, foci AS (SELECT DISTINCT hash, weak.word FROM weak JOIN wh ON wh.word = weak.raw)"""

# DuckDB measures distances in bytes, so every character gets a byte of its own: the characters outside ASCII that occur
# take the ASCII characters that don't, in order.
_CODE = r"""seen AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(lower(word), '')) AS c FROM voc)),
    odd AS (SELECT c, row_number() OVER (ORDER BY c) AS i FROM seen WHERE ord(c) > 127), free AS (SELECT chr(k) AS c, row_number() OVER (ORDER BY k) AS i FROM (SELECT CAST(unnest(range(1, 127)) AS INT) AS k) WHERE chr(k) NOT IN (SELECT c FROM seen)),
    code AS (SELECT string_agg(odd.c, '' ORDER BY odd.i) AS a, string_agg(free.c, '' ORDER BY odd.i) AS b FROM odd LEFT JOIN free USING (i)),
    coded AS (SELECT word, translate(lower(word), (SELECT a FROM code), (SELECT b FROM code)) AS low FROM voc)"""
_LOWFREQ = "lf AS (SELECT lower(word) AS low, CAST(sum(CASE WHEN freq >= 100000000 THEN freq - 100000000 ELSE freq END) + CASE WHEN max(freq) >= 100000000 THEN 100000000 ELSE 0 END AS BIGINT) AS low_freq FROM voc GROUP BY 1)"


def _pairs(conf: str, distance: int) -> str:
    same = "" if distance < 2 else """
        UNION ALL SELECT a.word, b.word, a.hash, b.hash, 0, 2 FROM (SELECT DISTINCT hash FROM idx) i JOIN w a ON a.hash = i.hash JOIN w b ON b.hash = i.hash AND a.word < b.word
            JOIN coded ca ON ca.word = a.word JOIN coded cb ON cb.word = b.word WHERE levenshtein(ca.low, cb.low) = 2"""
    lexical = "" if distance < 2 else "AND (kwc > 0 OR cl >= 100000000)"
    return f"""WITH {_ANA}, {_KEYS}, {conf}, {_IDX}, {_CODE}, {_LOWFREQ},
        band AS (SELECT word, freq FROM voc WHERE length(word) BETWEEN 5 AND 35), lfb AS (SELECT lower(word) AS low, CAST(sum(CASE WHEN freq >= 100000000 THEN freq - 100000000 ELSE freq END) + CASE WHEN max(freq) >= 100000000 THEN 100000000 ELSE 0 END AS BIGINT) AS low_freq FROM band GROUP BY 1),
        w AS (SELECT ana.hash, ana.word FROM ana JOIN band USING (word)),
        raw AS (SELECT a.word AS w1, b.word AS w2, a.hash AS h1, b.hash AS h2, i.kwc, levenshtein(ca.low, cb.low) AS ld
            FROM idx i JOIN w a ON a.hash = i.hash JOIN w b ON b.hash = i.hash + i.kwc JOIN coded ca ON ca.word = a.word JOIN coded cb ON cb.word = b.word WHERE levenshtein(ca.low, cb.low) <= {distance}{same}),
        freq AS (SELECT raw.*, la.low_freq AS l1, lb.low_freq AS l2, (la.low_freq > lb.low_freq OR (la.low_freq = lb.low_freq AND h1 < h2)) AS flip FROM raw JOIN lfb la ON la.low = lower(w1) JOIN lfb lb ON lb.low = lower(w2)),
        o AS (SELECT CASE WHEN flip THEN w2 ELSE w1 END AS v, CASE WHEN flip THEN w1 ELSE w2 END AS c, CASE WHEN flip THEN l2 ELSE l1 END AS vl, CASE WHEN flip THEN l1 ELSE l2 END AS cl, kwc, ld FROM freq),
        p AS (SELECT *, list_filter(string_split(v, '_'), lambda x: x <> '') AS pv, list_filter(string_split(c, '_'), lambda x: x <> '') AS pc FROM o WHERE vl < 100000000 {lexical})
        SELECT v AS variant, a.freq AS variant_freq, vl AS low_variant_freq, c AS candidate, b.freq AS candidate_freq, cl AS low_candidate_freq, CAST(kwc AS BIGINT) AS kwc, CAST(ld AS INT) AS ld,
            CAST(greatest(length(lower(v)), length(lower(c))) - ld AS INT) AS cls, CAST(cl >= 100000000 AS INT) AS canon, CAST(lower(v)[1] = lower(c)[1] AS INT) AS fl,
            CAST(length(v) > 1 AND length(c) > 1 AND right(lower(v), 2) = right(lower(c), 2) AS INT) AS ll, 0 AS khc, CAST(0 AS BIGINT) AS ngram_points
        FROM p JOIN band a ON a.word = v JOIN band b ON b.word = c WHERE len(pv) <> len(pc) OR len(pv) <= 1 OR lower(v) = lower(c)"""


_REC = """rec AS (SELECT variant, candidate, variant_freq, candidate_freq, low_variant_freq, low_candidate_freq, char_conf_val AS kwc, ld, cls, canon, fl, ll, khc, ngram_points, coalesce(cosine, 0) AS cosine FROM rank_record
    WHERE variant IS NOT NULL AND candidate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant, candidate ORDER BY rec_id) = 1)"""
_COUNTS = "cnt AS (SELECT kwc, count(*) AS pairs1 FROM rec GROUP BY kwc)"
_PARTS = "list_filter(string_split(variant, '_'), lambda x: x <> '')"
_KEPT = f"""proven AS (SELECT DISTINCT variant FROM rec WHERE ngram_points > 0),
    kept AS (SELECT * FROM rec r WHERE coalesce(ngram_points, 1) <> 0 OR variant NOT IN (SELECT v FROM (SELECT variant AS v, unnest({_PARTS}) AS part FROM rec WHERE ngram_points = 0) WHERE part IN (SELECT variant FROM proven)))"""


def _median(source: str, keys: str) -> str:
    return f"""SELECT {keys}, CAST((list_sort(list(candidate_freq))[(count(candidate_freq) + 1) // 2] + list_sort(list(candidate_freq))[count(candidate_freq) // 2 + 1]) // 2 AS BIGINT) AS median FROM {source} GROUP BY {keys}"""


_PAIRS2 = """two AS (SELECT cnt.kwc, string_split(example, '') AS e FROM conf JOIN cnt USING (kwc) WHERE regexp_matches(example, '^..~..$')),
    four AS (SELECT two.kwc, coalesce(n1.pairs1, 0) AS n1, coalesce(n2.pairs1, 0) AS n2, coalesce(n3.pairs1, 0) AS n3, coalesce(n4.pairs1, 0) AS n4 FROM two
        JOIN letters_all a ON a.ch = e[1] JOIN letters_all b ON b.ch = e[2] JOIN letters_all c ON c.ch = e[4] JOIN letters_all d ON d.ch = e[5]
        LEFT JOIN cnt n1 ON n1.kwc = abs(a.hash - c.hash) LEFT JOIN cnt n2 ON n2.kwc = abs(a.hash - d.hash) LEFT JOIN cnt n3 ON n3.kwc = abs(b.hash - c.hash) LEFT JOIN cnt n4 ON n4.kwc = abs(b.hash - d.hash)),
    p2 AS (SELECT kwc, greatest(n1, n2, n3) + CASE WHEN n1 >= n2 AND n1 >= n3 THEN n4 WHEN n2 >= n3 THEN n3 ELSE n2 END AS pairs2 FROM four WHERE greatest(n1, n2, n3) > 0)"""
_ABCD = "letters_all AS (SELECT ch, hash FROM alphabet WHERE ch NOT IN ('*', '$'))"


def _ranks(reduce: int = 0, local: bool = False, complements: bool = False, skip: tuple[int, ...] = ()) -> str:
    """CTEs up to `scored`, with all feature ranks."""
    f = f"CASE WHEN candidate_freq >= {reduce} THEN candidate_freq - {reduce} ELSE candidate_freq END" if reduce else "candidate_freq"
    med = f"med AS ({_median('kept' if local else 'rec', 'variant, kwc' if local else 'kwc')})"
    extra = f", {_CONF2}, {_ABCD}, {_PAIRS2}" if complements else ""
    p2 = "coalesce(p2.pairs2, 0)" if complements else "0"
    join = "LEFT JOIN p2 USING (kwc)" if complements else ""
    dense = {"freq_digits": "DESC", "freq": "DESC", "ld": "ASC", "cls": "DESC", "pairs1": "DESC", "pairs2": "DESC", "median": "DESC", "lower_count": "DESC", "ngram_points": "DESC"}
    ranks = ", ".join(f"dense_rank() OVER (PARTITION BY variant ORDER BY {c} {o} NULLS {'LAST' if o == 'DESC' else 'FIRST'}) AS {c}_rank" for c, o in dense.items())
    names = ("freq_digits", "freq", "ld", "cls", "canon", "fl", "ll", "khc", "pairs1", "pairs2", "median", "lower_count", "cosine", "ngram_points")
    total = " + ".join(f"{c}_rank" for i, c in enumerate(names, 1) if i not in skip)
    return f"""{_REC}, {_COUNTS}, {_KEPT}, {med}{extra},
        feat AS (SELECT kept.*, {f} AS freq, length(CAST({f} AS VARCHAR)) AS freq_digits, pairs1, {p2} AS pairs2, median, count(*) OVER (PARTITION BY variant, lower(candidate)) AS lower_count FROM kept JOIN cnt USING (kwc) JOIN med USING ({'variant, kwc' if local else 'kwc'}) {join}),
        ranked AS (SELECT *, {ranks}, CASE WHEN canon = 0 THEN 10 ELSE 1 END AS canon_rank, CASE WHEN fl = 0 THEN 2 ELSE 1 END AS fl_rank, CASE WHEN ll = 0 THEN 2 ELSE 1 END AS ll_rank, CASE WHEN khc = 0 THEN 2 ELSE 1 END AS khc_rank,
            CASE WHEN cosine <= 0.001 THEN 1 ELSE 10 END AS cosine_rank FROM feat),
        summed AS (SELECT *, {total} AS rank_sum FROM ranked),
        scored AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY variant) = 1 THEN 1.0 ELSE 1 - rank_sum / CAST(sum(rank_sum) OVER (PARTITION BY variant) AS DOUBLE) END AS score FROM summed)"""


def _best(clip: int, **options) -> str:
    return f"""WITH {_ranks(**options)} SELECT variant, variant_freq, candidate, candidate_freq, kwc, ld, round(score, 9) AS score FROM scored
        QUALIFY row_number() OVER (PARTITION BY variant ORDER BY round(score, 9) DESC, candidate) <= {clip}"""


_RISING = f"""{_VOC}, {_ranks()}, rising AS (SELECT variant, vf.freq AS variant_freq, candidate, cf.freq AS candidate_freq, kwc, ld, score FROM scored JOIN voc vf ON vf.word = variant JOIN voc cf ON cf.word = candidate WHERE cf.freq > vf.freq),
    firsts AS (SELECT * FROM rising QUALIFY row_number() OVER (PARTITION BY variant ORDER BY round(score, 9) DESC, candidate) = 1)"""
_CHAIN = f"""RECURSIVE {_RISING}, path AS (SELECT variant, candidate AS head FROM firsts UNION ALL SELECT p.variant, f.candidate FROM path p JOIN firsts f ON f.variant = p.head),
    root AS (SELECT p.variant, p.head FROM path p WHERE p.head NOT IN (SELECT variant FROM firsts)), {_LETTERS}, {_hashes('voc')}, {_CODE}"""

_VEC = "unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings)"


def _near(query: str, apart: str, k: int) -> str:
    return f"""WITH {_VEC}, q AS ({query}), s AS (SELECT qid, u.vec_id AS word, round(list_cosine_similarity(q.v, u.v), 12) AS similarity FROM q, unit u WHERE {apart})
        SELECT qid, word, round(similarity, 5) AS similarity, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, word) AS position FROM s WHERE similarity > 0 QUALIFY position <= {k}"""


_UNQUOTED = r"""list_filter(list_transform(regexp_extract_all(l, '"(?:[^"]|"")*"|[^"\t]+'), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END), lambda x: x <> '')"""
_NUMBER = "(regexp_matches({0}, '^[0-9]+$') AND (length(ltrim({0}, '0')) < 19 OR (length(ltrim({0}, '0')) = 19 AND ltrim({0}, '0') <= '9223372036854775807')))"


def _raw(table: str, only: str = "") -> str:
    return rf"""WITH clean AS (SELECT line_id, regexp_replace(regexp_replace(line, '^\x{{FEFF}}', ''), '\r\z', '') AS l FROM {table}),
        cut AS (SELECT line_id, l, regexp_matches(l, '\A(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*\z') AS quoting, {_UNQUOTED} AS f FROM clean WHERE l IS NOT NULL AND NOT regexp_matches(l, '\A[ \t]*\z') {only})"""


_ALPHABET_OK = f"quoting AND len(f) = 3 AND length(f[1]) = 1 AND {_NUMBER.format('f[2]')} AND {_NUMBER.format('f[3]')}"
_BACKGROUND_OK = rf"quoting AND len(f) IN (1, 2) AND NOT regexp_matches(f[1], '[\p{{Z}}\s\p{{Cc}}\x{{FFFD}}]') AND (len(f) = 1 OR {_NUMBER.format('f[2]')})"
_RAW_A, _RAW_B = _raw("fillalphabet", "AND l NOT LIKE '#%'"), _raw("read_backgound")


def _class(word: str, letters: bool = True) -> str:
    """CASE for the class of a word."""
    rest = "translate({0}, (SELECT string_agg(c, '') FROM (SELECT DISTINCT unnest([ch, lower(ch), upper(ch)]) AS c FROM alphabet WHERE ch NOT IN ('*', '$')) WHERE length(c) = 1), '')" if letters else r"regexp_replace({0}, '[\p{{Lu}}\p{{Ll}}]', '', 'g')"
    rest = rest.format(word)
    n, blanks = f"length({word})", rf"(length({rest}) - length(regexp_replace({rest}, '{_BLANK}', '', 'g')))"
    d, p = rf"(length({rest}) - length(regexp_replace({rest}, '\p{{Nd}}', '', 'g')))", (rf"(length({rest}) - length(replace({rest}, '.', '')))" if letters else rf"(length({rest}) - length(regexp_replace({rest}, '\p{{P}}', '', 'g')))")
    letter = f"({n} - length({rest}))"
    out = f"(length({rest}) - {blanks} - {d} - {p})"
    roman = "regexp_matches({0}, '^M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$')".format(word)
    return f"""CASE WHEN {n} < 2 OR {roman} OR {d} = {n} OR {d} >= {letter} + {out} THEN 'IGNORE'
        WHEN ({n} >= 4 AND ({letter} + {d}) / {n} >= 0.75) OR ({n} = 3 AND ({letter} + {d}) / {n} >= 0.66) OR ({n} < 3 AND {out} + {d} < 1)
            OR ({n} >= 8 AND {letter} + {p} > {n} - 2) OR ({n} >= 4 AND {letter} + {p} > {n} - 1) THEN 'CLEAN' ELSE 'UNK' END"""


_HEAD, _TAIL = rf"length(regexp_extract(word, '^(?:{_EDGE}|-[^\p{{Lu}}\p{{Ll}}])+'))", rf"length(regexp_extract(word, '(?:{_EDGE}|[^\p{{Lu}}\p{{Ll}}]-)+$'))"
_STRIPPED = f"CASE WHEN {_HEAD} + {_TAIL} < length(word) THEN substr(word, {_HEAD} + 1, length(word) - {_HEAD} - {_TAIL}) ELSE '' END"

_PLAIN = rf"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(word, 'Œ(\p{{Lu}})', 'OE\1', 'g'), 'Œ', 'Oe'), 'ß', 'ss'), 'œ', 'oe'), '[~#]', '*', 'g'), '[\-\x{{AD}}\x{{2010}}-\x{{2015}}\x{{2212}}]+', '-', 'g'), '[•·]', '.', 'g').replace(chr(160), '_').replace('æ', 'ae').replace('Æ', 'AE').replace('ĳ', 'ij').replace('Ĳ', 'IJ').replace('ﬁ', 'fi').replace('ﬂ', 'fl').replace('ﬀ', 'ff')"""
_GLUED = rf"""list_transform(p, lambda x, i: CASE WHEN i = 1 AND word LIKE '\_%' ESCAPE '\' THEN '_' ELSE '' END || x || CASE WHEN i = len(p) AND word LIKE '%\_' ESCAPE '\' THEN '_' ELSE '' END)"""
# Classification: words to parts, distinct parts to classes, classes folded into the word's, rows for the tables.
_CLASSIFIED = rf"""{_LIST}, norm AS (SELECT word AS orig, freq, {_PLAIN} AS word FROM list), cut AS (SELECT *, list_filter(string_split(word, '_'), lambda x: x <> '') AS p FROM norm),
    glued AS (SELECT orig, freq, word, {_GLUED} AS parts FROM cut WHERE len(p) > 0 AND NOT (len(p) = 2 AND length(word) < 6) AND NOT (len(p) = 3 AND length(word) < 8)),
    piece AS (SELECT DISTINCT unnest(parts) AS word FROM glued), s AS (SELECT word, {_STRIPPED} AS bare, {_HEAD} + {_TAIL} > 0 AS edged FROM piece),
    k AS (SELECT word, bare, edged, {_class('word')} AS own, {_class('bare')} AS inner_ FROM s),
    pc AS (SELECT word AS part, bare, CASE WHEN NOT edged THEN own WHEN bare = '' THEN CASE WHEN length(word) < 3 THEN 'IGNORE' ELSE 'UNK' END WHEN inner_ = 'CLEAN' THEN 'PUNCT' ELSE inner_ END AS cls FROM k),
    each AS (SELECT orig, freq, word, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM glued),
    folded AS (SELECT orig, any_value(freq) AS freq, any_value(word) AS word, any_value(parts) AS parts, string_agg(CASE WHEN cls = 'PUNCT' THEN bare ELSE part END, '_' ORDER BY i) AS final,
        list(CASE WHEN len(parts) > 1 AND length(part) = 1 AND NOT regexp_matches(part, '^[a-zA-Z0-9-]$') THEN 'LONE' WHEN i = 2 AND part = '-' AND len(parts) > 2 AND cls = 'IGNORE' THEN 'HYPHEN' ELSE cls END ORDER BY i) AS cs FROM each JOIN pc USING (part) GROUP BY orig),
    word_class AS (SELECT *, list_reduce(cs, lambda st, x: CASE WHEN st IN ('IGNORE', 'LONE', 'UNK') OR x IN ('LONE', 'IGNORE') THEN 'IGNORE' WHEN x = 'HYPHEN' THEN CASE WHEN st = 'CLEAN' THEN 'CLEAN' ELSE 'IGNORE' END
        WHEN st = 'CLEAN' AND x = 'UNK' THEN 'IGNORE' WHEN st = 'PUNCT' OR x = 'PUNCT' THEN 'PUNCT' ELSE 'CLEAN' END) AS cl FROM folded),
    named AS (SELECT *, regexp_matches(CASE WHEN cl = 'PUNCT' THEN final ELSE word END, '^(\p{{Lu}}{{1,2}}\.{{1,2}}(\p{{Lu}}{{1,2}}\.{{1,2}})*)(\p{{Lu}}{{0,2}})$') AS dotted,
        list_sort(list_distinct(list_filter(list_transform(range(1, len(parts)), lambda i: regexp_extract(parts[i] || '_' || parts[i + 1], '^(?:de|het|een)_(\p{{Lu}}+)-?\p{{L}}*$', 1)), lambda x: x <> ''))) AS heads FROM word_class WHERE cl IN ('CLEAN', 'UNK', 'PUNCT')),
    routed AS (SELECT 'clean' AS tag, CASE WHEN cl = 'PUNCT' AND NOT dotted THEN final ELSE word END AS key, NULL AS value, freq, orig FROM named WHERE cl = 'CLEAN' OR dotted OR (cl = 'PUNCT' AND len(heads) = 0)
        UNION ALL SELECT 'punct', orig, word, freq, orig FROM named WHERE cl = 'CLEAN' AND word <> orig UNION ALL SELECT 'punct', final, word, freq, orig FROM named WHERE cl = 'PUNCT' AND dotted
        UNION ALL SELECT 'punct', orig, final, freq, orig FROM named WHERE cl = 'PUNCT' AND NOT dotted AND len(heads) = 0 UNION ALL SELECT 'unk', orig, NULL, freq, orig FROM named WHERE cl = 'UNK' AND NOT dotted AND len(heads) = 0)"""

SQL: dict[str, str] = {
    "classify_clean": f"WITH {_CLASSIFIED} SELECT key AS word, CAST(sum(freq) AS BIGINT) AS freq FROM routed WHERE tag = 'clean' GROUP BY key",
    "classify_unk": f"WITH {_CLASSIFIED} SELECT key AS word, CAST(sum(freq) AS BIGINT) AS freq FROM routed WHERE tag = 'unk' GROUP BY key",
    "classify_punct": f"WITH {_CLASSIFIED} SELECT key AS word, arg_max(value, orig) AS form FROM routed WHERE tag = 'punct' GROUP BY key",
    "p4_found": f"SELECT 'fillalphabet' AS src, line_id FROM ({_RAW_A} SELECT line_id FROM cut WHERE NOT ({_ALPHABET_OK})) UNION ALL SELECT 'read_backgound', line_id FROM ({_RAW_B} SELECT line_id FROM cut WHERE NOT ({_BACKGROUND_OK}))",
    "p4_alphabet": f"{_RAW_A} SELECT line_id, f[1] AS ch, CAST(f[2] AS BIGINT) AS freq, CAST(f[3] AS BIGINT) AS hash FROM cut WHERE {_ALPHABET_OK}",
    "p4_background": f"{_RAW_B} SELECT line_id, f[1] AS word, CAST(f[2] AS BIGINT) AS freq FROM cut WHERE {_BACKGROUND_OK}",
    "word_count": f"SELECT word, count(*) AS freq FROM (SELECT unnest({_tokens('text')}) AS word FROM documents) GROUP BY word",
    "word_count_bigrams": f"SELECT word, count(*) AS freq FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS word FROM (SELECT {_tokens('lower(text)')} AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) > 1) GROUP BY word",
    "word_count_line_trigrams": f"SELECT word, count(*) AS freq FROM (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || '_' || t[i + 1] || '_' || t[i + 2])) AS word FROM (SELECT {_tokens('l')} AS t FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE len(t) > 2) GROUP BY word",
    "emphasis_runs": rf"""WITH t AS (SELECT doc_id, unnest({_tokens('text')}) AS w, generate_subscripts({_tokens('text')}, 1) AS i FROM documents),
        e AS (SELECT doc_id, w, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM t WHERE regexp_matches(w, '^[\p{{L}}\p{{Nd}}]$'))
        SELECT doc_id, string_agg(w, '_' ORDER BY i) AS run FROM e GROUP BY doc_id, g HAVING count(*) > 1""",
    "wordfreq_totals": f"WITH {_LIST} SELECT word, freq, CAST(sum(freq) OVER (ORDER BY freq DESC, word ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumsum, round(100 * sum(freq) OVER (ORDER BY freq DESC, word ROWS UNBOUNDED PRECEDING) / sum(freq) OVER (), 6) AS pct FROM list",
    "wordfreq_summary": f"WITH {_LIST} SELECT CAST(sum(freq) AS BIGINT) AS tokens, count(*) AS types, round(count(*) / sum(freq), 9) AS ttr, round(degrees(atan(count(*) / sum(freq))), 6) AS angle FROM list",
    "wordfreq_clip": f"WITH {_LIST} SELECT * FROM list WHERE freq > 5",
    "merge_lexicons": f"WITH {_LIST}, {_VOC} SELECT word, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT * FROM list UNION ALL SELECT * FROM voc) GROUP BY word",
    "lexicon_last_wins": "SELECT wrd AS word, frq AS freq FROM read_words WHERE wrd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wrd ORDER BY row_id DESC) = 1",
    "lexclean_clean": f"WITH {_LIST} SELECT * FROM list WHERE translate(word, {_ABC}, '') = ''",
    "lexclean_dirty": f"WITH {_LIST} SELECT * FROM list WHERE translate(word, {_ABC}, '') <> ''",
    "lexclean_reverse": f"WITH {_LIST} SELECT * FROM list WHERE translate(word, {_ABC}, '') = word",
    "length_band": f"WITH {_LIST} SELECT * FROM list WHERE length(word) BETWEEN 5 AND 35",
    "char_count": "SELECT ch, count(*) AS freq FROM (SELECT unnest(string_split(lower(wrd), '')) AS ch FROM read_words WHERE wrd <> '') GROUP BY ch",
    "alphabet_build": rf"""WITH c AS (SELECT ch, count(*) AS freq FROM (SELECT unnest(string_split(lower(wrd), '')) AS ch FROM read_words WHERE wrd <> '') GROUP BY ch),
        r AS (SELECT ch, freq, 102 + row_number() OVER (ORDER BY freq DESC, ch DESC) AS k FROM c WHERE freq >= 20 AND ch NOT IN ('*', '$', '_') AND NOT regexp_matches(ch, '{_BLANK}'))
        SELECT ch, freq, CAST(k * k * k * k * k AS BIGINT) AS hash FROM r UNION ALL VALUES ('*', 0, 10000000000), ('$', 0, 10510100501), ('_', 0, 11040808032)""",
    "confusions_ld1": f"WITH {_CONF1} SELECT kwc, example FROM conf",
    "confusions_ld2": f"WITH {_CONF2} SELECT kwc, example FROM conf",
    "diacritic_confusions": "SELECT abs(a.hash - b.hash) AS kwc, a.ch || '~' || b.ch AS example FROM alphabet a JOIN alphabet b ON b.ch = strip_accents(a.ch) WHERE a.ch <> b.ch",
    "text_functions": rf"""WITH {_LIST}, x AS (SELECT word, list_filter(string_split(word, '_'), lambda x: x <> '') AS p FROM list)
        SELECT word, regexp_matches(word, '^M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$') AS roman, regexp_matches(word, '^(\p{{Lu}}{{1,2}}\.{{1,2}}(\p{{Lu}}{{1,2}}\.{{1,2}})*)(\p{{Lu}}{{0,2}})$') AS dotted,
        regexp_replace(word, '\p{{P}}', '', 'g') AS no_punct, translate(word, '~#', '__') AS no_tilde, {_STRIPPED} AS stripped,
        {_PLAIN} AS plain,
        array_to_string({_GLUED}, '|') AS parts,
        array_to_string(list_filter(string_split_regex(word, '[_-]'), lambda x: x <> ''), '|') AS dash_parts FROM x""",
    "accents_stripped": f"WITH {_VOC} SELECT word, strip_accents(word) AS plain FROM voc",
    "fifth_powers": "SELECT p_partkey, CAST((p_partkey % 3000) * (p_partkey % 3000) * (p_partkey % 3000) * (p_partkey % 3000) * (p_partkey % 3000) AS BIGINT) AS fifth FROM part",
    "pair_distances": f"""WITH {_VOC}, {_CODE} SELECT rec_id, CAST(levenshtein(a.low, b.low) AS INT) AS caseless_ld, CAST(greatest(length(lower(variant)), length(lower(candidate))) - levenshtein(a.low, b.low) AS INT) AS cls
        FROM rank_record JOIN coded a ON a.word = variant JOIN coded b ON b.word = candidate""",
    "word_classes": rf"""WITH {_LIST}, s AS (SELECT word, {_STRIPPED} AS bare, {_HEAD} + {_TAIL} > 0 AS edged FROM list),
        k AS (SELECT word, bare, edged, {_class('word')} AS own, {_class('bare')} AS inner_ FROM s),
        c AS (SELECT word, bare, CASE WHEN NOT edged THEN own WHEN bare = '' THEN CASE WHEN length(word) < 3 THEN 'IGNORE' ELSE 'UNK' END WHEN inner_ = 'CLEAN' THEN 'PUNCT' ELSE inner_ END AS cls FROM k)
        SELECT word, cls, CASE WHEN cls = 'PUNCT' THEN bare ELSE '' END AS form FROM c""",
    "word_classes_general": f"WITH {_LIST} SELECT word, {_class('word', False)} AS cls FROM list",
    "hash_list": f"WITH {_VOC}, {_LETTERS}, {_hashes('voc')} SELECT word, hash FROM hs",
    "anagram_table": f"WITH {_ANA} SELECT hash, word FROM ana",
    "anagram_lines": f"WITH {_ANA} SELECT hash || '~' || string_agg(word, '#' ORDER BY word) AS value FROM ana GROUP BY hash",
    "background_merge": f"WITH {_LIST}, {_VOC} SELECT word, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT * FROM list UNION ALL SELECT * FROM voc) GROUP BY word",
    "foci": f"WITH {_VOC}, {_LETTERS}, {_FOCI} SELECT hash, word FROM foci",
    "anagram_keys": f"WITH {_ANA}, {_KEYS} SELECT hash FROM keys",
    "index_confusion_driven": f"WITH {_ANA}, {_KEYS}, {_CONF1}, {_IDX} SELECT kwc, hash FROM idx",
    "index_focus_driven": f"WITH {_ANA}, {_KEYS}, {_CONF1}, {_IDX}, {_FOCI} SELECT kwc, hash FROM idx WHERE hash IN (SELECT hash FROM foci) OR hash + kwc IN (SELECT hash FROM foci)",
    "index_stats": f"WITH {_ANA}, {_KEYS}, {_CONF1}, {_IDX} SELECT kwc, count(*) AS n FROM idx GROUP BY kwc",
    "low_frequencies": f"WITH {_VOC}, {_LOWFREQ} SELECT low, low_freq FROM lf",
    "pairs_ld1": _pairs(_CONF1, 1),
    "pairs_ld2": _pairs(_CONF2, 2).replace(_IDX, "idx AS (SELECT b.hash - a.hash AS kwc, a.hash FROM keys a JOIN keys b ON b.hash > a.hash AND b.hash - a.hash <= (SELECT max(kwc) FROM conf) WHERE b.hash - a.hash IN (SELECT kwc FROM conf))"),
    "confusion_counts": f"WITH {_REC} SELECT kwc, count(*) AS pairs1 FROM rec GROUP BY kwc",
    "confusion_medians": f"WITH {_REC} {_median('rec', 'kwc')}",
    "confusion_medians_local": f"WITH {_REC} {_median('rec', 'variant, kwc')}",
    "confusion_complements": f"WITH {_REC}, {_COUNTS}, {_CONF2}, {_ABCD}, {_PAIRS2} SELECT kwc, pairs2 FROM p2",
    "confusion_frequencies": f"WITH {_REC}, {_COUNTS}, {_CONF2} SELECT kwc, coalesce(example, CASE WHEN kwc = 0 THEN 'transposition' ELSE 'missing' END) AS example, pairs1 AS n FROM cnt LEFT JOIN conf USING (kwc)",
    "ngram_evidence_filter": f"WITH {_REC}, {_KEPT} SELECT variant, candidate FROM kept",
    "feature_ranks": f"WITH {_ranks(reduce=100000000)} SELECT variant, candidate, " + ", ".join(f"{c}_rank" for c in ("freq_digits", "freq", "ld", "cls", "canon", "fl", "ll", "khc", "pairs1", "pairs2", "median", "lower_count", "cosine", "ngram_points")) + ", rank_sum, round(score, 9) AS score FROM scored",
    "rank_best": _best(1),
    "rank_top5": _best(5, skip=(10, 11)),
    "rank_local_medians": _best(3, local=True),
    "rank_with_complements": _best(5, complements=True),
    "first_candidates": f"WITH {_RISING} SELECT variant, candidate FROM firsts",
    "chain": f"""WITH {_CHAIN} SELECT f.variant, f.variant_freq, r.head, v.freq AS head_freq, CASE WHEN r.head = f.candidate THEN f.kwc ELSE abs(a.hash - b.hash) END AS kwc, CAST(levenshtein(x.low, y.low) AS INT) AS ld
        FROM firsts f JOIN root r USING (variant) JOIN voc v ON v.word = r.head JOIN hs a ON a.word = f.variant JOIN hs b ON b.word = r.head JOIN coded x ON x.word = r.head JOIN coded y ON y.word = f.variant""",
    "vectors_cosine": "SELECT a.vec_id AS a, a.vec_id + 1 AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "vectors_nearest": _near("SELECT vec_id AS qid, v FROM unit WHERE vec_id % 50 = 0", "u.vec_id <> qid", 20),
    "vectors_analogy": _near("SELECT a.vec_id AS qid, list_transform(range(1, len(a.v) + 1), lambda i: b.v[i] - a.v[i] + c.v[i]) AS v FROM unit a JOIN unit b ON b.vec_id = a.vec_id + 1 JOIN unit c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 50 = 0", "u.vec_id NOT IN (qid, qid + 1, qid + 2)", 40),
}
SQL["stream_word_count"] = SQL["word_count"]
SQL["index_met_in_the_middle"] = SQL["index_chosen"] = SQL["index_confusion_driven"]
SQL["xml_text_nodes"] = rf"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{FFFE}}\x{{FFFF}}\r]', '', 'g'), chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS node, text FROM l WHERE NOT regexp_matches(text, '\A{_BLANK}*\z')"""


# Faulty raw lines: the fields before the first that breaks the quoting, and what follows them.
def _reasons(table: str, raw: str, least: int, most: int, faults: str) -> str:
    return rf"""SELECT '{table}' AS src, line_id, reason, CAST(at_byte AS INT) AS at_byte FROM ({raw}, part AS (SELECT *, regexp_extract(l, '\A(?:(?:"(?:[^"]|"")*"|[^"\t]*)\t)*') AS good FROM cut),
        rest AS (SELECT *, substr(l, length(good) + 1) AS bad FROM part)
        SELECT line_id, CASE WHEN NOT quoting THEN CASE WHEN bad NOT LIKE '"%' THEN 'quote inside an unquoted field' WHEN regexp_matches(bad, '\A"(?:[^"]|"")*\z') THEN 'unclosed quote' ELSE 'text after a closing quote' END
                WHEN len(f) NOT BETWEEN {least} AND {most} THEN 'fields: ' || len(f) {faults} END AS reason,
            CASE WHEN quoting THEN NULL WHEN bad NOT LIKE '"%' THEN strlen(good) + strlen(regexp_extract(bad, '\A[^"]*')) WHEN regexp_matches(bad, '\A"(?:[^"]|"")*\z') THEN strlen(good) ELSE strlen(good) + strlen(regexp_extract(bad, '\A"(?:[^"]|"")*"')) END AS at_byte FROM rest) WHERE reason IS NOT NULL"""


def _number_fault(name: str, field: str) -> str:
    return f"WHEN {field} IS NOT NULL AND NOT regexp_matches({field}, '^[0-9]+$') THEN '{name}: not a number' WHEN {field} IS NOT NULL AND NOT {_NUMBER.format(field)} THEN '{name}: number too large'"


SQL["p4_reasons"] = _reasons("fillalphabet", _RAW_A, 3, 3, f"WHEN length(f[1]) <> 1 THEN 'ch: not one character' {_number_fault('freq', 'f[2]')} {_number_fault('hash', 'f[3]')}") + " UNION ALL " + _reasons(
    "read_backgound", _RAW_B, 1, 2, rf"WHEN regexp_matches(f[1], '[\p{{Z}}\s\p{{Cc}}\x{{FFFD}}]') THEN 'word: blank, control or replacement character' {_number_fault('freq', 'f[2]')}")
SQL["alphabet_reader"] = r"""WITH f AS (SELECT list_filter(string_split(replace(line, chr(13), ''), chr(9)), lambda x: x <> '') AS f FROM fillalphabet WHERE replace(line, chr(13), '') NOT LIKE '#%'),
    n AS (SELECT f[1][1] AS ch, TRY_CAST(regexp_extract(f[2], '^[\s\x0b]*([0-9]+)', 1) AS BIGINT) AS freq, TRY_CAST(regexp_extract(f[3], '^[\s\x0b]*([0-9]+)', 1) AS BIGINT) AS hash FROM f WHERE len(f) = 3)
    SELECT * FROM n WHERE freq > 100 OR freq = 0"""
SQL["confusions_all_examples"] = f"WITH {_SYMBOLS}, {_SETS1}, {_DIFFS} SELECT kwc, array_to_string(list_sort(list_distinct(list(example))), '#') AS examples FROM diffs GROUP BY kwc"

# Words of the documents, and n-grams of two words of a line.
_UNIGRAMS = f"SELECT word, count(*) AS freq FROM (SELECT unnest({_tokens('text')}) AS word FROM documents) GROUP BY word"
_BIGRAMS = f"SELECT word, count(*) AS freq FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS word FROM (SELECT {_tokens('l')} AS t FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE len(t) > 1) GROUP BY word"
_GRAMS = f"grams AS ({_UNIGRAMS} UNION ALL {_BIGRAMS})"
SQL["foci_of_parts"] = f"""WITH {_GRAMS}, {_LETTERS}, lexical AS (SELECT DISTINCT word FROM grams WHERE freq >= 50), weak AS (SELECT DISTINCT word FROM grams WHERE freq < 50 AND lower(word) NOT IN (SELECT word FROM lexical)),
    held AS (SELECT DISTINCT g.word FROM (SELECT word, unnest(list_filter(string_split(word, '_'), lambda x: x <> '')) AS part FROM grams) g JOIN weak ON weak.word = g.part), {_hashes('held')}
    SELECT DISTINCT hash, lower(word) AS word FROM hs"""
# Words within one letter: the same once a letter is left out at the same place, or one is the other without a letter.
_NEAR = f"""{_GRAMS}, {_LETTERS}, {_CONF1}, tame AS (SELECT DISTINCT translate(word, '~#', '__') AS word FROM grams WHERE word <> ''), {_hashes('tame')}, ana AS (SELECT hash, word FROM hs WHERE hash > 0), {_KEYS},
    clean AS (SELECT word, max(freq) AS freq FROM grams WHERE length(word) BETWEEN 5 AND 35 GROUP BY word),
    low AS (SELECT lower(word) AS low, CAST(sum(CASE WHEN freq >= 50 THEN freq - 50 ELSE freq END) + CASE WHEN max(freq) >= 50 THEN 50 ELSE 0 END AS BIGINT) AS n FROM clean GROUP BY 1),
    w AS (SELECT a.word, lower(a.word) AS l, a.hash FROM ana a JOIN clean USING (word) WHERE a.hash IN (SELECT hash FROM keys)),
    cut AS (SELECT word, l, hash, i, left(l, i - 1) || substr(l, i + 1) AS rest FROM (SELECT *, CAST(unnest(range(1, length(l) + 1)) AS INT) AS i FROM w)),
    close AS (SELECT a.word AS w1, b.word AS w2, a.hash AS h1, b.hash AS h2 FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest WHERE a.hash < b.hash
        UNION SELECT CASE WHEN a.hash < b.hash THEN a.word ELSE b.word END, CASE WHEN a.hash < b.hash THEN b.word ELSE a.word END, least(a.hash, b.hash), greatest(a.hash, b.hash) FROM w a JOIN cut b ON a.l = b.rest WHERE a.hash <> b.hash),
    freqd AS (SELECT c.*, la.n AS l1, lb.n AS l2, la.n > lb.n OR (la.n = lb.n AND h1 < h2) AS flip FROM close c JOIN low la ON la.low = lower(w1) JOIN low lb ON lb.low = lower(w2) WHERE h2 - h1 IN (SELECT kwc FROM conf)),
    o AS (SELECT CASE WHEN flip THEN w2 ELSE w1 END AS v, CASE WHEN flip THEN w1 ELSE w2 END AS c FROM freqd WHERE CASE WHEN flip THEN l2 ELSE l1 END < 50),
    p AS (SELECT *, list_filter(string_split(v, '_'), lambda x: x <> '') AS pv, list_filter(string_split(c, '_'), lambda x: x <> '') AS pc FROM o),
    d AS (SELECT v, c, list_filter(list_transform(range(1, len(pv) + 1), lambda i: CASE WHEN lower(pv[i]) <> lower(pc[i]) THEN [pv[i], pc[i]] END), lambda x: x IS NOT NULL) AS d FROM p WHERE len(pv) = len(pc) AND len(pv) > 1),
    parts AS (SELECT v, c, d[1][1] AS part1, d[1][2] AS part2 FROM d WHERE len(d) = 1 AND lower(d[1][1]) NOT IN (SELECT low FROM low WHERE n >= 50))"""
SQL["ngram_part_counts"] = f"WITH {_NEAR} SELECT part1, part2, count(*) AS n FROM parts WHERE length(part1) >= 5 GROUP BY ALL"
SQL["ngram_ambiguous"] = f"WITH {_NEAR} SELECT part1 || '~' || part2 AS pair, array_to_string(list_sort(list_distinct(list(v || '~' || c))), '#') AS ngram_pairs FROM parts WHERE length(part1) < 5 GROUP BY part1, part2"
SQL["ngram_short_pairs"] = f"""WITH {_NEAR}, few AS (SELECT part1 AS v, part2 AS c, lower(part1) AS a, lower(part2) AS b, count(*) AS n FROM parts WHERE length(part1) < 5 GROUP BY ALL)
    SELECT v AS variant, coalesce(fv.freq, 0) AS variant_freq, coalesce(lv.n, 0) AS low_variant_freq, c AS candidate, coalesce(fc.freq, 0) AS candidate_freq, coalesce(lc.n, 0) AS low_candidate_freq, CAST(0 AS BIGINT) AS kwc, 1 AS ld,
        CAST(greatest(length(a), length(b)) - 1 AS INT) AS cls, CAST(coalesce(lc.n, 0) >= 50 AS INT) AS canon, CAST(left(a, 1) = left(b, 1) AS INT) AS fl, CAST(length(a) > 1 AND length(b) > 1 AND right(a, 2) = right(b, 2) AS INT) AS ll, 0 AS khc, few.n AS ngram_points
    FROM few LEFT JOIN clean fv ON fv.word = v LEFT JOIN clean fc ON fc.word = c LEFT JOIN low lv ON lv.low = a LEFT JOIN low lc ON lc.low = b"""

# Pairs marked by historical and diacritic confusions, candidates in the alphabet; historical pairs at any distance if wanted.
_HISTORICAL = "hist AS (SELECT DISTINCT abs(a.hash - b.hash) AS kwc FROM alphabet a, alphabet b WHERE a.ch || b.ch IN ('sz', 'iy', 'ck', 'uv', 'fv'))"
_DIACRITIC = "dia AS (SELECT DISTINCT abs(a.hash - b.hash) AS kwc FROM alphabet a JOIN alphabet b ON b.ch = strip_accents(a.ch) WHERE a.ch <> b.ch)"


def _marked(excused: bool) -> str:
    plain = _pairs(_CONF1, 1)
    more = " OR i.kwc IN (SELECT kwc FROM hist)" if excused else ""
    out = plain.replace("WITH ", f"WITH {_HISTORICAL}, {_DIACRITIC}, ", 1).replace("<= 1),", f"<= 1{more}),", 1)
    out = out.replace("WHERE vl < 100000000 )", f"WHERE (vl < 100000000 OR kwc IN (SELECT kwc FROM dia)) AND translate(lower(c), {_ABC}, '') = '')")
    return out.replace("0 AS khc", "CAST(kwc IN (SELECT kwc FROM hist) AS INT) AS khc")


SQL["pairs_marked"], SQL["pairs_historical_any_distance"] = _marked(False), _marked(True)

# The pipeline over a ready vocabulary: pairs at distance 1 with candidates in the alphabet, the best of each variant.
_PIPED = "rec AS (SELECT variant, candidate, variant_freq, candidate_freq, low_variant_freq, low_candidate_freq, kwc, ld, cls, canon, fl, ll, khc, ngram_points, 0.0 AS cosine FROM (" + _pairs(_CONF1, 1).replace("WHERE vl < 100000000 )", f"WHERE vl < 100000000 AND translate(lower(c), {_ABC}, '') = '')") + "))"
SQL["pipeline_ranked"] = _best(1).replace(_REC, _PIPED)



def _distance(a: str, b: str) -> str:
    """Distance by characters: those of the two words take ASCII characters by their place among them."""
    coded = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(CAST(32 + list_position(list_distinct(string_split({a} || {b}, '')), c) AS INT))), '')"
    return f"CAST(levenshtein({coded(a)}, {coded(b)}) AS INT)"


SQL["chain_cased"] = f"""WITH RECURSIVE {_RISING}, {_LETTERS}, named AS (SELECT *, list_filter(string_split(lower(candidate), ''), lambda x: NOT list_contains(string_split(lower(variant), ''), x)) AS more FROM firsts),
    best AS (SELECT * FROM named WHERE NOT (kwc = 10510100501 AND length(candidate) > length(variant) AND len(more) > 0 AND more[1] NOT IN (SELECT ch FROM letters))),
    path AS (SELECT variant, candidate AS head FROM best UNION ALL SELECT p.variant, f.candidate FROM path p JOIN best f ON f.variant = p.head), root AS (SELECT p.variant, p.head FROM path p WHERE p.head NOT IN (SELECT variant FROM best)),
    {_hashes('voc')}
    SELECT f.variant, f.variant_freq, r.head, v.freq AS head_freq, CASE WHEN r.head = f.candidate THEN f.kwc ELSE abs(a.hash - b.hash) END AS kwc, {_distance('r.head', 'f.variant')} AS ld
    FROM best f JOIN root r USING (variant) JOIN voc v ON v.word = r.head JOIN hs a ON a.word = f.variant JOIN hs b ON b.word = r.head"""

# Acronyms: capital words behind an article, and dotted ones of the same letters.
_ACRO = r"""heads_ AS (SELECT key, sum(freq) AS freq FROM (SELECT unnest(heads) AS key, freq FROM named WHERE NOT dotted) GROUP BY key),
    dots AS (SELECT CASE WHEN cl = 'PUNCT' THEN final ELSE word END AS key, sum(freq) AS freq FROM named WHERE dotted GROUP BY 1)
    SELECT key AS word, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT * FROM heads_ UNION ALL SELECT * FROM dots WHERE regexp_replace(key, '\p{P}', '', 'g') IN (SELECT key FROM heads_)) GROUP BY key"""
SQL["classify_acronyms"] = f"WITH {_CLASSIFIED}, {_ACRO}"
_MADE = r"""list AS (SELECT word, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest(['de_' || upper(wrd), array_to_string(string_split(upper(wrd), ''), '.') || '.']) AS word, coalesce(frq, 0) AS freq FROM read_words WHERE regexp_matches(wrd, '^[a-z]+$')) GROUP BY word)"""
SQL["classify_made_acronyms"] = SQL["classify_acronyms"].replace(_LIST, _MADE)

_BACK = _CLASSIFIED.replace(_LIST, f"{_VOC}, bg AS (SELECT word, freq FROM voc WHERE freq >= 100000000), known AS (SELECT DISTINCT lower(word) AS w FROM bg), {_LIST}").replace(
    "CASE WHEN NOT edged THEN own WHEN bare", "CASE WHEN lower(word) IN (SELECT w FROM known) THEN 'CLEAN' WHEN NOT edged THEN own WHEN bare").replace(
    "AS final,", "AS final, bool_and(lower(part) IN (SELECT w FROM known) OR (cls = 'PUNCT' AND lower(bare) IN (SELECT w FROM known))) AS lex,").replace(
    "freq, orig FROM named WHERE cl = 'CLEAN' OR dotted OR", "freq, orig, lex AND (cl = 'CLEAN' OR (cl = 'PUNCT' AND NOT dotted)) AS lex FROM named WHERE cl = 'CLEAN' OR dotted OR").replace(
    ", freq, orig FROM named", ", freq, orig, false FROM named")
_FORE = f"{_BACK}, fore AS (SELECT key AS word, CAST(sum(freq) + CASE WHEN bool_or(lex) AND sum(freq) < 100000000 THEN 100000000 ELSE 0 END AS BIGINT) AS f FROM routed WHERE tag = 'clean' GROUP BY key), both_ AS (SELECT coalesce(fore.word, bg.word) AS word, f, coalesce(freq, 0) AS b FROM fore FULL JOIN bg ON fore.word = bg.word)"
SQL["classify_foreground"] = f"WITH {_FORE} SELECT word, CASE WHEN f + b > 200000000 THEN f + b - 100000000 ELSE f + b END AS freq FROM both_ WHERE f IS NOT NULL"
SQL["classify_with_background"] = f"WITH {_FORE} SELECT word, CASE WHEN f IS NULL THEN b WHEN f > 100000000 AND b >= 100000000 THEN f - 100000000 + b ELSE f + b END AS freq FROM both_"

SQL["emphasis_runs_spaced"] = rf"""WITH t AS (SELECT row_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT row_id, {_tokens("array_to_string(string_split(wrd, ''), ' ')")} AS t FROM read_words)),
    e AS (SELECT row_id, w, i, i - row_number() OVER (PARTITION BY row_id ORDER BY i) AS g FROM t WHERE regexp_matches(w, '^[\p{{L}}\p{{Nd}}]$'))
    SELECT row_id, string_agg(w, '_' ORDER BY i) AS run FROM e GROUP BY row_id, g HAVING count(*) > 1"""
SQL["vectors_pair_freqs"] = """WITH f AS (SELECT row_id, max(frq) AS freq FROM read_words GROUP BY row_id)
    SELECT vec_id AS a, vec_id + 1 AS b, coalesce(x.freq, 0) AS freq_a, coalesce(y.freq, 0) AS freq_b FROM embeddings LEFT JOIN f x ON x.row_id = vec_id LEFT JOIN f y ON y.row_id = vec_id + 1"""
SQL["vectors_neighbour_cosines"] = f"SELECT qid AS variant, word AS candidate, similarity AS cosine FROM ({SQL['vectors_nearest']}) WHERE word > qid AND word <= qid + 100"

# Lines of the file formats.
SQL["wordfreq_lines"] = f"SELECT word || chr(9) || freq AS value FROM ({SQL['wordfreq_clip']})"
SQL["alphabet_lines"] = f"""SELECT CASE WHEN ch = '*' THEN '# *' || chr(9) || 'digits_and_punctuation' || chr(9) || hash WHEN ch = '$' THEN '# $' || chr(9) || 'unknown_characters' || chr(9) || hash
    WHEN freq = 0 THEN ch || chr(9) || freq || chr(9) || chr(9) || hash ELSE ch || chr(9) || freq || chr(9) || hash END AS value FROM ({SQL['alphabet_build']})"""
SQL["confusion_lines"] = f"SELECT kwc || '#' || example AS value FROM ({SQL['confusions_ld1']})"
SQL["index_lines"] = f"SELECT kwc || '#' || string_agg(hash, ',' ORDER BY hash) AS value FROM ({SQL['index_chosen']}) GROUP BY kwc"
SQL["pairs_lines"] = "SELECT " + " || '~' || ".join(("variant", "variant_freq", "low_variant_freq", "candidate", "candidate_freq", "low_candidate_freq", "kwc", "ld", "cls", "canon", "fl", "ll", "khc", "ngram_points")) + f" AS value FROM ({SQL['pairs_ld1']})"
SQL["ranked_lines"] = f"SELECT variant || '#' || variant_freq || '#' || candidate || '#' || candidate_freq || '#' || kwc || '#' || ld || '#' || format('{{:.6g}}', CAST(score AS DOUBLE)) AS value FROM ({SQL['rank_best']})"
SQL["chained_lines"] = f"SELECT variant || '#' || variant_freq || '#' || head || '#' || head_freq || '#' || kwc || '#' || ld || '#C' AS value FROM ({SQL['chain']})"
SQL["charconfreq_lines"] = f"SELECT kwc || chr(9) || example || chr(9) || n AS value FROM ({SQL['confusion_frequencies']})"
SQL["quarantine_lines"] = f"SELECT word AS value FROM ({SQL['lexclean_dirty']})"
SQL["wordfreq_clean_lines"] = f"SELECT CASE WHEN freq = 0 THEN word ELSE word || chr(9) || freq END AS value FROM ({SQL['lexclean_clean']})"
SQL["hash_list_lines"] = f"SELECT word || chr(9) || hash AS value FROM ({SQL['hash_list']})"
SQL["confstats_lines"] = f"SELECT kwc || '#' || n AS value FROM ({SQL['index_stats']})"
SQL["punct_lines"] = f"SELECT word || chr(9) || form AS value FROM ({SQL['classify_punct']})"
SQL["ambiguous_lines"] = f"SELECT pair || '#' || ngram_pairs || '#' AS value FROM ({SQL['ngram_ambiguous']})"

# Readers: over the raw lines of the tables, and over the lines that the sinks write.
_FIELDS = "list_filter(string_split({0}, chr(9)), lambda x: x <> '')"
_WORDS = "list_filter(string_split_regex({0}, '[\\s\\x0b]+'), lambda x: x <> '')"
_INT = "TRY_CAST(regexp_extract({0}, '^[\\s\\x0b]*([0-9]+)', 1) AS BIGINT)"


def _read(fields: str, columns: str, keep: str) -> str:
    return f"SELECT * FROM (SELECT {columns} FROM (SELECT {fields} AS f FROM read_backgound WHERE line IS NOT NULL)) WHERE {keep}"


SQL["foreground_reader"] = _read(_FIELDS.format("trim(line)"), f"f[1] AS word, {_INT.format('f[2]')} AS freq", "freq IS NOT NULL")
SQL["background_reader"] = _read(_FIELDS.format("line"), f"f[1] AS word, coalesce({_INT.format('f[2]')}, 100000000) AS freq, len(f) AS n", "n IN (1, 2)").replace("SELECT * FROM (SELECT f[1]", "SELECT word, freq FROM (SELECT f[1]", 1)
SQL["lexicon_reader"] = _read(_WORDS.format("line"), f"f[1] AS word, {_INT.format('f[2]')} AS freq", "freq IS NOT NULL")
SQL["tagged_reader"] = _read(_FIELDS.format("line"), f"f[1] AS word, coalesce({_INT.format('f[2]')}, 0) AS freq, len(f) AS n", "n IN (1, 2, 4)").replace("SELECT * FROM (SELECT f[1]", "SELECT word, freq FROM (SELECT f[1]", 1)
SQL["frequencies_reader"] = _read(_WORDS.format("line"), f"f[1] AS word, {_INT.format('f[2]')} AS freq, len(f) AS n", "freq IS NOT NULL AND n = 2").replace("SELECT * FROM (SELECT f[1]", "SELECT word, freq FROM (SELECT f[1]", 1)
SQL["hemps_reader"] = "SELECT line AS word FROM read_backgound WHERE line <> '' AND line NOT LIKE '#%'"
SQL["foci_reader"] = f"SELECT DISTINCT hash FROM ({SQL['anagram_table']})"
SQL["anagrams_reader"], SQL["confusions_reader"], SQL["flagged_reader"], SQL["index_reader"], SQL["pairs_reader"] = SQL["anagram_table"], SQL["confusions_ld1"], SQL["confusions_ld1"], SQL["index_chosen"], SQL["pairs_ld1"]
SQL["ranked_reader"] = f"SELECT variant, variant_freq, candidate, candidate_freq, kwc, ld, CAST(format('{{:.6g}}', CAST(score AS DOUBLE)) AS DOUBLE) AS score FROM ({SQL['rank_best']})"
SQL["chained_reader"] = f"SELECT variant, variant_freq, head, head_freq, kwc, ld, 'C' AS flag FROM ({SQL['chain']})"
