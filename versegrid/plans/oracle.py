"""The same queries as SQL text for DuckDB, for comparison with the Spark results."""

from __future__ import annotations

from versegrid.functions import stem as P
from versegrid.functions import text as T
from versegrid.operators.tokens import STOP_WORDS
from versegrid.plans.catalog import DENSE_EPS, EVENT_GENRES


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _fold(c: str) -> str:
    for char, spelling in T.FOLD_LONGER.items():
        c = f"replace({c}, {_lit(char)}, {_lit(spelling)})"
    c = f"translate({c}, {_lit(T.FOLD_FROM)}, {_lit(T.FOLD_TO)})"
    return rf"regexp_replace({c}, '[^\x00-\x7F]', '', 'g')"


def _inline(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '[\n\r\t ]+', ' ', 'g'), {_lit(T.STRIP_SET)}))"


_SPACE = T.SPACE_CLASS


def _dash(c: str) -> str:
    kept = f"regexp_replace({_fold(c)}, '[^a-zA-Z0-9{_SPACE}-]', '', 'g')"
    return f"lower(trim(regexp_replace({kept}, ' +', '-', 'g'), '-'))"


def _underscore(c: str) -> str:
    kept = f"regexp_replace(regexp_replace({_fold(c)}, '[./]', '_', 'g'), '[^a-zA-Z0-9{_SPACE}_]', '', 'g')"
    return f"lower(trim(regexp_replace(regexp_replace({kept}, ' +', '_', 'g'), '_+', '_', 'g'), '_'))"


def _compact(c: str) -> str:
    return f"lower(regexp_replace({_fold(c)}, '[^a-zA-Z0-9]', '', 'g'))"


def _letter(slug: str) -> str:
    return f"CASE WHEN regexp_matches({slug}, '^[a-z]') THEN substr({slug}, 1, 1) ELSE '0-9' END"


# -- stems: one column per step ------------------------------------------------------------

def _cut(n) -> str:
    return f"left(w, length(w) - {n})"


def _suffix_case(rules: dict[str, str]) -> str:
    branches = []
    for suffix in sorted(rules, key=len, reverse=True):
        rest = _cut(len(suffix))
        measured = f"({rest} || 'l')" if suffix == "logi" else rest
        branches.append(
            f"WHEN suffix(w, '{suffix}') THEN CASE WHEN regexp_matches({measured}, '{P.MEASURE_1_UP}') "
            f"THEN {rest} || '{rules[suffix]}' ELSE w END")
    return f"CASE {' '.join(branches)} ELSE w END"


def _step4_case() -> str:
    branches = []
    for suffix in sorted(P.STEP4, key=len, reverse=True):
        rest = _cut(len(suffix))
        also = f" AND regexp_matches({rest}, '[st]$')" if suffix == "ion" else ""
        branches.append(f"WHEN suffix(w, '{suffix}') THEN CASE WHEN regexp_matches({rest}, '{P.MEASURE_2_UP}'){also} "
                        f"THEN {rest} ELSE w END")
    return f"CASE {' '.join(branches)} ELSE w END"


def _stem_steps() -> list[str]:
    has_vowel = lambda rest: f"regexp_matches({rest}, '{P.HAS_VOWEL}')"
    b = "left(w, length(w) - 1)"
    return [
        f"CASE WHEN regexp_matches(w, '^.ies$') THEN {_cut(1)} WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {_cut(2)} "
        f"WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {_cut(1)} ELSE w END",
        f"CASE WHEN regexp_matches(w, '^.ied$') THEN {_cut(1)} WHEN suffix(w, 'ied') THEN {_cut(2)} "
        f"WHEN suffix(w, 'eed') THEN CASE WHEN regexp_matches({_cut(3)}, '{P.MEASURE_1_UP}') THEN {_cut(1)} ELSE w END "
        f"WHEN suffix(w, 'ed') THEN CASE WHEN {has_vowel(_cut(2))} THEN {_cut(2)} || '+' ELSE w END "
        f"WHEN suffix(w, 'ing') THEN CASE WHEN {has_vowel(_cut(3))} THEN {_cut(3)} || '+' ELSE w END ELSE w END",
        f"CASE WHEN NOT suffix(w, '+') THEN w WHEN regexp_matches({b}, '(at|bl|iz)$') THEN {b} || 'e' "
        f"WHEN length({b}) > 1 AND right({b}, 1) = left(right({b}, 2), 1) AND regexp_matches({b}, '[^aeiou]$') "
        f"THEN CASE WHEN regexp_matches({b}, '[lsz]$') THEN {b} ELSE left(w, length(w) - 2) END "
        f"WHEN regexp_matches({b}, '{P.MEASURE_1}') AND regexp_matches({b}, '{P.SHORT_END}') THEN {b} || 'e' ELSE {b} END",
        # letters before the last y, each marked v or c, y by the letter before it; long runs of y alternate
        f"CASE WHEN suffix(w, 'y') AND length(w) > 2 AND CASE "
        f"WHEN NOT suffix({b}, 'y') THEN NOT regexp_matches({b}, '[aeiou]$') "
        f"ELSE (length(regexp_extract({b}, 'y+$')) + CASE WHEN regexp_matches({b}, '[^aeiouy]y+$') THEN 1 ELSE 0 END) % 2 = 1 END "
        f"THEN {b} || 'i' ELSE w END",
        f"CASE WHEN suffix(w, 'alli') AND regexp_matches({_cut(4)}, '{P.MEASURE_1_UP}') THEN {_cut(2)} ELSE w END",
        _suffix_case(P.STEP2),
        _suffix_case(P.STEP3),
        _step4_case(),
        f"CASE WHEN suffix(w, 'e') AND (regexp_matches({_cut(1)}, '{P.MEASURE_2_UP}') OR "
        f"(regexp_matches({_cut(1)}, '{P.MEASURE_1}') AND NOT regexp_matches({_cut(1)}, '{P.SHORT_END}'))) THEN {_cut(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND regexp_matches({_cut(1)}, '{P.MEASURE_2_UP}') THEN {_cut(1)} ELSE w END",
    ]


_WORDS = r"SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')) AS term FROM {table}"
_STOP = ", ".join(_lit(w) for w in STOP_WORDS)


def _token_ctes(table: str = "documents", key: str = "doc_id", text: str = "text", stop: bool = True) -> str:
    keep = f" AND term NOT IN ({_STOP})" if stop else ""
    words = _WORDS.format(key=key, text=text, table=table)
    return f"toks AS (SELECT * FROM ({words}) WHERE length(term) > 1{keep})"


def _stem_ctes() -> str:
    parts = ["g0 AS MATERIALIZED (SELECT DISTINCT term, term AS w FROM toks)"]
    for i, step in enumerate(_stem_steps(), 1):
        parts.append(f"g{i} AS MATERIALIZED (SELECT term, {step} AS w FROM g{i - 1})")
    irregular = " ".join(f"WHEN '{word}' THEN '{stem}'" for word, stem in P.IRREGULAR.items())
    parts.append(f"dict AS MATERIALIZED (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE "
                 f"CASE term {irregular} ELSE w END END AS stem FROM g{len(parts) - 1})")
    return ", ".join(parts)


def _tf_ctes(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """toks, dict and tf: term counts of stems."""
    return (f"{_token_ctes(table, key, text)}, {_stem_ctes()}, tf AS MATERIALIZED (SELECT {key}, stem AS term, "
            f"count(*) AS tf FROM toks JOIN dict USING (term) GROUP BY {key}, stem)")


_KEEP = "df <= CAST(0.7 AS DOUBLE) * n"


def _idf_ctes(n: str = "(SELECT count(*) FROM documents)", source: str = "tf") -> str:
    return (f"cnt AS (SELECT {n} AS n), idf AS MATERIALIZED (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM "
            f"(SELECT term, count(*) AS df FROM {source} GROUP BY term), cnt WHERE {_KEEP})")


def _w_cte(key: str = "doc_id") -> str:
    return (f"raw AS (SELECT {key}, term, (1 + ln(tf)) * idf AS v FROM tf JOIN idf USING (term)), "
            f"w AS MATERIALIZED (SELECT {key}, term, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS weight FROM raw)")


def _split(table: str, key: str) -> str:
    return (f"SELECT {key}, CASE WHEN row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR)), {key}) <= "
            f"ceil((SELECT count(*) FROM {table}) * (1 - CAST(0.8 AS DOUBLE))) THEN 'testset' ELSE 'trainset' END AS part FROM {table}")


_TFIDF = f"WITH {_tf_ctes()}, {_idf_ctes()}, {_w_cte()}"

# -- tags ------------------------------------------------------------------------------------

_GENRES = "genres(ord, genre) AS (VALUES " + ", ".join(f"({o}, '{g}')" for o, g, _ in EVENT_GENRES) + ")"
_ALIASES = ("names(ord, genre, alias) AS (VALUES "
            + ", ".join(f"({o}, '{g}', '{a}')" for o, g, subs in EVENT_GENRES for a in [g, *subs])
            + "), aliases AS (SELECT alias, arg_min(genre, ord) AS genre FROM names GROUP BY alias)")


def _best(keys: str, tags: str, name: str = "best") -> str:
    """CTE: best genre per key, genres without a tag at 0, earlier genre on a tie."""
    return (f"{name} AS (SELECT {keys}, genre AS tag FROM (SELECT {keys}, genre, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY score DESC, ord) AS r FROM (SELECT k.*, g.ord, g.genre, coalesce(sum(t.count), 0) AS score "
            f"FROM (SELECT DISTINCT {keys} FROM {tags}) k CROSS JOIN genres g LEFT JOIN (SELECT * FROM {tags} JOIN aliases "
            f"ON name = alias) t USING ({keys}, genre) GROUP BY ALL)) WHERE r = 1)")


def _event_tags(where: str = "true") -> str:
    return f"(SELECT user_id AS artist, event_type AS name, count(*) AS count FROM events WHERE {where} GROUP BY ALL)"


# -- labelled corpus ---------------------------------------------------------------------------

_TAG_ROWS = ("tag_rows AS (SELECT doc_id AS trackid, 1 AS ord, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS tag FROM labels "
             "UNION ALL SELECT doc_id, 2, CASE WHEN quality = 1 THEN 'toxic' ELSE '' END FROM labels WHERE toxic = 1)")
_CORPUS = (f"{_TAG_ROWS}, last AS (SELECT trackid, arg_max(tag, ord) AS tag FROM tag_rows GROUP BY trackid), "
           "corpus AS MATERIALIZED (SELECT doc_id AS trackid, text AS lyrics, tag FROM documents JOIN last ON doc_id = trackid WHERE tag <> '')")

# naive Bayes on the split corpus: prediction per test row
_BAYES = f"""
WITH {_CORPUS}, labelled AS (SELECT trackid AS doc_id, lyrics AS text, tag AS label FROM corpus),
parts AS MATERIALIZED ({_split("labelled", "doc_id")}),
{_tf_ctes("labelled")},
train_tf AS (SELECT tf.* FROM tf JOIN parts USING (doc_id) WHERE part = 'trainset'),
{_idf_ctes("(SELECT count(*) FROM parts WHERE part = 'trainset')", "train_tf")}, {_w_cte()},
v AS (SELECT count(*) AS v FROM idf),
x AS (SELECT w.*, label FROM w JOIN parts USING (doc_id) JOIN labelled USING (doc_id) WHERE part = 'trainset'),
class_n AS (SELECT label, count(*) AS c FROM labelled JOIN parts USING (doc_id) WHERE part = 'trainset' GROUP BY label),
class_w AS (SELECT label, sum(weight) AS total FROM x GROUP BY label),
term_w AS (SELECT label, term, sum(weight) AS s FROM x GROUP BY label, term),
test AS (SELECT doc_id, label AS truth FROM labelled JOIN parts USING (doc_id) WHERE part = 'testset'),
lik AS (SELECT test.doc_id, class_n.label, sum(w.weight * ln((coalesce(s, 0) + 1e-5) / (coalesce(total, 0) + 1e-5 * v))) AS ll
  FROM test CROSS JOIN class_n JOIN w ON w.doc_id = test.doc_id LEFT JOIN term_w ON term_w.label = class_n.label AND term_w.term = w.term
  LEFT JOIN class_w ON class_w.label = class_n.label CROSS JOIN v GROUP BY ALL),
scored AS (SELECT test.doc_id, truth, class_n.label, ln(c / (SELECT sum(c) FROM class_n)) + coalesce(ll, 0) AS score
  FROM test CROSS JOIN class_n LEFT JOIN lik ON lik.doc_id = test.doc_id AND lik.label = class_n.label),
predicted AS (SELECT doc_id, truth AS label, label AS prediction FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM scored) WHERE r = 1)
"""
# every machine of a training language is optimal
_LANGUAGES_OK = f"""SELECT DISTINCT lang AS class, true AS ok FROM documents JOIN ({_split("documents", "doc_id")}) USING (doc_id)
WHERE part = 'trainset' AND lang IS NOT NULL"""
_REPORT = """report AS (SELECT class, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1, CAST(support AS BIGINT) AS support FROM
  (SELECT class, count(*) FILTER (label = class AND prediction = class) AS tp, count(*) FILTER (label = class) AS support,
    count(*) FILTER (prediction = class) AS predicted
   FROM (SELECT label AS class FROM predicted UNION SELECT prediction FROM predicted) CROSS JOIN predicted GROUP BY class))"""

# every pair of documents within the distance, by brute force over shared terms
_PAIRS = f"""{_TFIDF},
dots AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.weight * y.weight) AS dot FROM w x JOIN w y ON x.term = y.term GROUP BY ALL),
empty AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM w)),
near AS MATERIALIZED (SELECT a, b FROM dots WHERE dot >= 0.955 - 1e-9 UNION SELECT p.doc_id, q.doc_id FROM empty p, empty q),
deg AS MATERIALIZED (SELECT a AS doc_id, count(*) AS degree FROM near GROUP BY a)"""

_DENSE_PAIRS = f"""WITH 
near AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x, embeddings y
  WHERE list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) <= {DENSE_EPS}),
deg AS MATERIALIZED (SELECT a AS vec_id, count(*) AS degree FROM near GROUP BY a)"""

_HOMOGENEITY = f"""WITH {_CORPUS}, p AS (SELECT tag AS c, lang AS k, count(*) AS n FROM corpus JOIN documents ON doc_id = trackid GROUP BY ALL),
t AS (SELECT sum(n) AS t FROM p), cs AS (SELECT c, sum(n) AS s FROM p GROUP BY c), ks AS (SELECT k, sum(n) AS s FROM p GROUP BY k),
h AS (SELECT (SELECT -sum(s / t * ln(s / t)) FROM cs, t) AS hc, (SELECT -sum(s / t * ln(s / t)) FROM ks, t) AS hk,
  (SELECT -sum(n / t * ln(n / s)) FROM p JOIN ks USING (k), t) AS hck, (SELECT -sum(n / t * ln(n / s)) FROM p JOIN cs USING (c), t) AS hkc)
SELECT round(CASE WHEN abs(hc) < 1e-15 THEN 1 ELSE 1 - hck / hc END, 6) AS homogeneity,
  round(CASE WHEN abs(hk) < 1e-15 THEN 1 ELSE 1 - hkc / hk END, 6) AS completeness FROM h"""

# -- pages -------------------------------------------------------------------------------------


def _plain(markup: str) -> str:
    """Text of well-formed markup: tags dropped, the entities that the pages use resolved.

    HTML also resolves these names without their semicolon, as some cut-off texts have them.
    """
    c = f"regexp_replace({markup}, '<[^>]*>', '', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"regexp_replace({c}, '{entity}?', '{char}', 'g')"
    return c


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_BODY_TEXT = _plain(_ARTICLE)
_BODY_NEXT = _plain("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")
# a paragraph that opens with <b> is never closed and runs to the end of the article
_PIECES = f"string_split({_ARTICLE}, '<p>')[2:]"
_BODY_PARAGRAPHS = ("array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: CASE WHEN starts_with(pieces[i], '<b>') THEN "
                    + _plain("array_to_string(pieces[i:], '')") + " ELSE " + _plain("string_split(pieces[i], '</p>')[1]") + " END), ' ')")
_BODIES = f"bodies AS (SELECT page_id, url, {_BODY_TEXT} AS body_text, {_BODY_PARAGRAPHS} AS body_paragraphs, {_BODY_NEXT} AS body_next FROM (SELECT *, {_PIECES} AS pieces FROM pages))"
_SITE = (r"CASE WHEN regexp_matches(url, '^https?://blog\.') THEN 'blog' WHEN regexp_matches(url, '^https?://m\.') THEN 'mobile' "
         r"WHEN regexp_matches(url, '^https?://www\.') THEN 'www' END")
_NAV_LINKS = """links AS (SELECT page_id, pos - 1 AS pos, regexp_extract(li, '<a href="([^"]*)">([^<]*)</a>', 1) AS href,
  trim(regexp_extract(li, '<a href="([^"]*)">([^<]*)</a>', 2)) AS name FROM (SELECT page_id, items[pos] AS li, pos FROM
  (SELECT page_id, string_split(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>')[2:] AS items FROM pages), LATERAL (SELECT unnest(range(1, len(items) + 1)) AS pos)) WHERE regexp_matches(li, '<a href="([^"]*)">([^<]*)</a>'))"""

_TITLE = "' ' || p_name || ' Lyrics live Lyrics '"
_DROPPED = rf"regexp_replace({_TITLE}, '(?s)^(.*) Lyrics(.*)$', '\1\2')"


def _each(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS value FROM documents"


_E_COUNT = "length(text) - length(replace(text, 'e', ''))"

ORACLE = {
    "tsv_round_trip": "SELECT CAST(p_partkey AS BIGINT) AS trackid, 'http://host/' || p_type AS url, '\"' || p_brand AS artist, "
                      "p_name || ' \"live\"' AS title FROM part",
    "dataset_round_trip": f"SELECT doc_id, lang, text, part FROM documents JOIN ({_split('documents', 'doc_id')}) USING (doc_id) WHERE part = 'testset'",
    "shard_union": "SELECT doc_id, lang, n_chars FROM documents UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 4 = 1",
    "genre_dim": "SELECT CAST(row_number() OVER (ORDER BY genre) - 1 AS INTEGER) AS ord, genre, subgenres FROM (SELECT p_type AS genre, "
                 "array_to_string(list_sort(list(DISTINCT p_name)), '|') AS subgenres FROM part GROUP BY p_type)",
    "alias_to_genre": "WITH g AS (SELECT p_type AS genre, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS ord FROM part GROUP BY p_type), "
                      "a AS (SELECT genre AS alias, ord, genre FROM g UNION SELECT p_name, ord, genre FROM part JOIN g ON p_type = genre) "
                      "SELECT alias, min(ord) AS ord, arg_min(genre, ord) AS genre FROM a GROUP BY alias",
    "inline_text": _each(_inline("text")),
    "fold_ascii": _each(_fold("text")),
    "decoded_text": _each("text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) || 'A' || chr(65533) ELSE '' END"),
    "replace_last": _each(
        f"CASE WHEN {_E_COUNT} >= 2 THEN regexp_replace(text, '(?s)^(.*)e(.*)e(.*)$', '\\1<E>\\2<E>\\3') "
        f"WHEN {_E_COUNT} = 1 THEN replace(text, 'e', '<E>') ELSE text END"),
    "strip_suffix": f"SELECT p_partkey, trim({_DROPPED}) AS title, trim({_DROPPED}, {_lit(chr(10) + chr(13) + chr(92) + 's' + chr(9))}) AS compat_title FROM part",
    "slug_dash": _each(_dash("text")),
    "slug_underscore": _each(_underscore("text")),
    "slug_compact": _each(_compact("text")),
    "shard_letter": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '0-9' WHEN regexp_matches(lower(p_name), '^[a-z]') "
                    "THEN lower(p_name[1]) ELSE '0-9' END AS letter FROM part",
    "build_urls": f"SELECT p_partkey, 'metrolyrics' AS site, 'http://www.metrolyrics.com/' || {_dash('p_name')} || '-lyrics-' || {_dash('p_brand')} || '.html' AS url FROM part "
                  f"UNION ALL SELECT p_partkey, 'lyricscom', 'http://www.lyrics.com/' || {_dash('p_name')} || '-lyrics-' || {_dash('p_brand')} || '.html' FROM part "
                  f"UNION ALL SELECT p_partkey, 'lyricsmode', 'http://www.lyricsmode.com/lyrics/' || {_letter(_underscore('p_brand'))} || '/' || {_underscore('p_brand')} || '/' || {_underscore('p_name')} || '.html' FROM part "
                  f"UNION ALL SELECT p_partkey, 'azlyrics', 'http://www.azlyrics.com/lyrics/' || {_compact('p_brand')} || '/' || {_compact('p_name')} || '.html' FROM part",
    "route_pages": f"SELECT page_id, {_SITE} AS site FROM pages WHERE {_SITE} IS NOT NULL",
    "reject_pages": r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https?://blog\.')",
    "page_links": """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""",
    "track_links": f"WITH {_NAV_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, href, name FROM links",
    "frontier_pattern": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
        h AS (SELECT page_id, href || CASE WHEN page_id % 2 = 0 THEN '-lyrics.html' ELSE '-songs.html' END AS href FROM l),
        p AS (SELECT *, regexp_replace(href, '-lyrics.html$', '-alpage-{}.html') AS pattern FROM h)
        SELECT page_id, href, pattern, replace(pattern, '{}', '2') AS second FROM p""",
    "page_enumeration": """WITH l AS (SELECT page_id, page_id // 100 AS idx, page_id % 100 + 1 AS page, url,
          CASE WHEN page_id % 100 > 40 THEN regexp_replace(url, '#.*$', '') ELSE url END AS final_url FROM pages),
        stops AS (SELECT idx, min(page) AS stop FROM l WHERE url <> final_url GROUP BY idx)
        SELECT idx, page, url, final_url FROM l LEFT JOIN stops USING (idx), range(2) twice(n) WHERE page < coalesce(stop, 101) AND (n = 0 OR page_id % 3 = 0)""",
    "artist_page_list": "SELECT page_id, CASE WHEN page_id % 27 = 0 THEN '1' ELSE chr(CAST(96 + page_id % 27 AS INTEGER)) END AS idx, CAST(page_id // 27 + 1 AS INTEGER) AS page, "
                        "'http://www.metrolyrics.com/artists-' || CASE WHEN page_id % 27 = 0 THEN '1' ELSE chr(CAST(96 + page_id % 27 AS INTEGER)) END || '-' || (page_id // 27 + 1) || '.html' AS url FROM pages",
    "track_keys": f"WITH {_NAV_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, name, href AS url, row_number() OVER (ORDER BY page_id, pos) AS trackid FROM links",
    "crawl_tracks": """WITH p AS (SELECT p_name, p_partkey AS k, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS b FROM part),
        s AS (SELECT (b % 5, (b // 5) % 3, b, k // 1000, k) AS o, 'Brand & ' || b AS artist, p_name AS title,
          'http://host/brand-' || b || '/' || replace(p_name, ' ', '-') || '.html' AS url FROM p)
        SELECT row_number() OVER (ORDER BY o) AS trackid, url, artist, title FROM s""",
    "site_rule_lyrics": f"SELECT doc_id AS trackid, {_inline(_fold('text'))} AS lyrics FROM documents WHERE text <> ''",
    "vectorize": f"""WITH {_TAG_ROWS}, last AS (SELECT trackid, arg_max(tag, ord) AS tag FROM tag_rows GROUP BY trackid),
        twice AS (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 7 = 0),
        labelled AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, md5(text)) AS doc_id, doc_id AS trackid, text, tag AS label
          FROM twice JOIN last ON doc_id = trackid WHERE tag <> ''),
        parts AS MATERIALIZED ({_split("labelled", "doc_id")}), {_tf_ctes("labelled")},
        train_tf AS (SELECT tf.* FROM tf JOIN parts USING (doc_id) WHERE part = 'trainset'),
        {_idf_ctes("(SELECT count(*) FROM parts WHERE part = 'trainset')", "train_tf")}, {_w_cte()},
        ix AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM idf),
        v AS (SELECT doc_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS indices, sum(weight) AS s FROM w JOIN ix USING (term) GROUP BY doc_id)
        SELECT trackid, label, part, CAST((SELECT count(*) FROM idf) AS INTEGER) AS size, coalesce(indices, '') AS indices,
          round(coalesce(s, 0), 5) AS weight_sum FROM labelled JOIN parts USING (doc_id) LEFT JOIN v USING (doc_id)""",
    "page_bodies_text": f"WITH {_BODIES} SELECT page_id, body_text AS body FROM bodies",
    "page_bodies_paragraphs": f"WITH {_BODIES} SELECT page_id, body_paragraphs AS body FROM bodies",
    "page_bodies_next": f"WITH {_BODIES} SELECT page_id, body_next AS body FROM bodies",
    "nonempty_bodies": "SELECT * FROM (SELECT doc_id, regexp_replace(text, '^[A-M].*', '') AS raw FROM documents) WHERE raw <> ''",
    "extract_lyrics": f"WITH {_BODIES}, r AS (SELECT page_id, CASE {_SITE} WHEN 'blog' THEN body_text WHEN 'mobile' THEN body_paragraphs WHEN 'www' THEN body_next END AS body FROM bodies) "
                      f"SELECT page_id AS trackid, {_inline(_fold('body'))} AS lyrics FROM r WHERE body <> ''",
    "tag_json": f"SELECT * FROM {_event_tags('user_id % 10 <> 0')}",
    "genre_scores": f"WITH {_ALIASES} SELECT artist, genre, CAST(sum(count) AS BIGINT) AS score FROM {_event_tags()} JOIN aliases ON name = alias GROUP BY artist, genre",
    "best_genre": f"WITH {_GENRES}, {_ALIASES}, tags AS {_event_tags()}, {_best('artist', 'tags')} SELECT artist, tag FROM best",
    "best_genre_track": f"WITH {_GENRES}, {_ALIASES}, tags AS (SELECT user_id AS artist, props AS title, event_type AS name, count(*) AS count FROM events GROUP BY ALL), "
                        f"{_best('artist, title', 'tags')} SELECT artist, title, tag FROM best",
    "tag_tracks": f"WITH {_GENRES}, {_ALIASES}, tags AS {_event_tags()}, {_best('artist', 'tags')} "
                  "SELECT CAST(o_orderkey AS BIGINT) AS trackid, artist, o_orderstatus AS title, tag FROM orders JOIN best ON o_custkey = artist",
    "tagger_fallback": f"WITH {_GENRES}, {_ALIASES}, t1 AS {_event_tags('value > 60')}, t2 AS {_event_tags()}, {_best('artist', 't1', 'b1')}, {_best('artist', 't2', 'b2')} "
                       "SELECT CAST(o_orderkey AS BIGINT) AS trackid, CAST(o_custkey AS BIGINT) AS artist, o_orderstatus AS title, coalesce(b1.tag, b2.tag) AS tag FROM orders "
                       "LEFT JOIN b1 ON o_custkey = b1.artist LEFT JOIN b2 ON o_custkey = b2.artist WHERE coalesce(b1.tag, b2.tag) IS NOT NULL",
    "labelled_corpus": f"WITH {_CORPUS} SELECT * FROM corpus",
    "distinct_labels": f"WITH {_CORPUS} SELECT count(DISTINCT tag) AS n_labels FROM corpus",
    "tokens": f"WITH {_token_ctes(stop=False)} SELECT doc_id, term FROM toks",
    "tokens_no_stop": f"WITH {_token_ctes()} SELECT doc_id, term FROM toks",
    "stems": f"WITH {_token_ctes()}, {_stem_ctes()} SELECT term, stem FROM dict",
    "term_freq": f"WITH {_tf_ctes()} SELECT * FROM tf",
    "doc_freq": f"WITH {_tf_ctes()} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "idf": f"WITH {_tf_ctes()}, {_idf_ctes()} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf": f"{_TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM w",
    "tfidf_plain": f"WITH {_token_ctes(stop=False)}, tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL), {_idf_ctes()}, {_w_cte()} "
                   "SELECT doc_id, term, round(weight, 6) AS weight FROM w",
    "tfidf_transform": f"WITH parts AS MATERIALIZED ({_split('documents', 'doc_id')}), {_tf_ctes()}, train_tf AS (SELECT tf.* FROM tf JOIN parts USING (doc_id) WHERE part = 'trainset'), "
                       f"{_idf_ctes(chr(40) + 'SELECT count(*) FROM parts WHERE part = ' + _lit('trainset') + ')', 'train_tf')}, {_w_cte()} "
                       "SELECT doc_id, term, round(weight, 6) AS weight FROM w JOIN parts USING (doc_id) WHERE part = 'testset'",
    "sparse_vectors": f"{_TFIDF}, ix AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM idf), "
                      "v AS (SELECT doc_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS indices, sum(weight) AS s FROM w JOIN ix USING (term) GROUP BY doc_id) "
                      "SELECT d.doc_id, CAST((SELECT count(*) FROM idf) AS INTEGER) AS size, coalesce(indices, '') AS indices, round(coalesce(s, 0), 5) AS weight_sum FROM documents d LEFT JOIN v USING (doc_id)",
    "split_parts": _split("documents", "doc_id"),
    "corpus_profile": f"WITH {_tf_ctes()}, {_idf_ctes()} SELECT (SELECT count(*) FROM documents) AS samples, (SELECT count(*) FROM idf) AS features",
    "top_terms": f"{_TFIDF}, m AS (SELECT lang, term, sum(weight) AS total FROM w JOIN documents USING (doc_id) GROUP BY ALL), "
                 "s AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang), r AS (SELECT lang, term, round(total / docs, 6) AS mean_weight FROM m JOIN s USING (lang)) "
                 "SELECT * FROM (SELECT lang, term, mean_weight, row_number() OVER (PARTITION BY lang ORDER BY mean_weight DESC, term) AS rank FROM r) WHERE rank <= 10",
    "eps_neighbours": f"{_PAIRS} SELECT doc_id, degree FROM deg",
    "dbscan": _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
        core AS MATERIALIZED (SELECT doc_id FROM deg WHERE degree >= 5),
        links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        roots AS MATERIALIZED (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a),
        border AS (SELECT near.a AS doc_id, min(root) AS root FROM near JOIN roots ON near.b = roots.doc_id WHERE near.a NOT IN (FROM core) GROUP BY near.a),
        numbered AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM roots))
        SELECT d.doc_id, CAST(coalesce(c, -1) AS INTEGER) AS cluster FROM documents d LEFT JOIN (FROM roots UNION ALL FROM border) x USING (doc_id) LEFT JOIN numbered USING (root)""",
    "eps_neighbours_dense": f"{_DENSE_PAIRS} SELECT vec_id, degree FROM deg",
    "dbscan_dense": _DENSE_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
        core AS MATERIALIZED (SELECT vec_id FROM deg WHERE degree >= 5),
        links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        roots AS MATERIALIZED (SELECT a AS vec_id, min(b) AS root FROM reach GROUP BY a),
        border AS (SELECT near.a AS vec_id, min(root) AS root FROM near JOIN roots ON near.b = roots.vec_id WHERE near.a NOT IN (FROM core) GROUP BY near.a),
        numbered AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM roots))
        SELECT e.vec_id, CAST(coalesce(c, -1) AS INTEGER) AS cluster FROM embeddings e LEFT JOIN (FROM roots UNION ALL FROM border) x USING (vec_id) LEFT JOIN numbered USING (root)""",
    "contingency": f"WITH {_CORPUS} SELECT tag, lang, count(*) AS n FROM corpus JOIN documents ON doc_id = trackid GROUP BY tag, lang",
    "homogeneity_completeness": _HOMOGENEITY,
    "naive_bayes": f"{_BAYES} SELECT * FROM predicted",
    "svm_optimality": _LANGUAGES_OK,
    "accuracy_f1": f"{_BAYES}, {_REPORT} SELECT round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM predicted), 6) AS accuracy, "
                   "round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM report",
    "classification_report": f"{_BAYES}, {_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report",
}
