"""The SQL that states the queries of :mod:`core_queries`, for DuckDB."""

from __future__ import annotations

from riwaya.functions import classify, isnad
from riwaya.functions import text as X
from riwaya.functions.normalize import sql_normalize
from riwaya.sources import readers

NEEDLE, QUICK, SCOPE, EDITION = "الناس", "في", "qafila", "sharh-wadi-01"
VERSES = [(59, 6), (7, 29), (84, 12), (1, 1), (2, 3), (102, 16), (98, 32)]
PICKS = [(1, "qafila", 1), (2, "nahr", 0), (3, "none", 1), (4, "wadi", 12), (5, "tall", 99)]
GENERATIONS = ["Companion", "Follower (Tabi') [2nd Generation]", "Follower", "Succ. (Taba' Tabi') [3rd generation]", "3rd Century AH", "12th generation", "the Prophet", "تابعي", "unknown", "", None]
MIN_WORDS = 5


def _sql(text: str) -> str:
    return text.replace("'", "''")


def norm(e: str, profile: str = "link") -> str:
    return sql_normalize(e, profile)


def words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: w <> '')"


def java(pattern: str) -> str:
    r"""A pattern of Java as RE2 takes it in a string of SQL; \s of Java is ASCII there too."""
    return _sql(pattern)


ITEMS = f"items AS (SELECT id AS item, {norm('text_ar')} AS item_text, ref_key AS ref, surah, ayah, {words(norm('text_ar'))} AS w FROM unit WHERE kind = 'ayah')"
DOCS = f"docs AS (SELECT id AS doc, {norm('text_ar')} AS doc_text FROM unit WHERE kind = 'hadith')"
QUOTES = f"""probes AS (SELECT DISTINCT item, list_aggregate(w[i:i+{MIN_WORDS - 1}], 'string_agg', ' ') AS probe FROM items, range(1, len(w) - {MIN_WORDS} + 2) t(i)),
pairs AS (SELECT DISTINCT item, doc FROM probes JOIN docs ON contains(doc_text, probe)),
spans AS (SELECT item, i, n, list_aggregate(w[i:i+n-1], 'string_agg', ' ') AS run FROM items, range(1, len(w) + 1) t(i), range({MIN_WORDS}, len(w) - i + 2) s(n)),
quotes AS (SELECT item, doc, arg_min(run, n * -100000 + i) AS quoted, max(n)::INT AS quoted_words FROM pairs JOIN docs USING (doc) JOIN spans USING (item) WHERE contains(doc_text, run) GROUP BY item, doc)"""
ALSO = """also AS (SELECT q.item, q.quoted, string_agg(o.ref, ',' ORDER BY o.surah, o.ayah, o.ref, o.item) AS also, string_agg(o.ref, '، ' ORDER BY o.surah, o.ayah, o.ref, o.item) AS listed
FROM (SELECT DISTINCT item, quoted FROM quotes) q JOIN items o ON contains(o.item_text, q.quoted) AND o.item <> q.item GROUP BY q.item, q.quoted)"""
TITLES = f"""titles AS (SELECT item, name, row_number() OVER (PARTITION BY item ORDER BY id) AS place, {norm('name')} AS needle FROM
(SELECT from_unit AS item, regexp_extract(evidence_ar, '«(.*?)»', 1) AS name, min(id) AS id FROM link WHERE method = 'naming' GROUP BY 1, 2)),
names AS (SELECT item, doc, arg_min(name, place) AS named FROM titles JOIN docs ON needle <> '' AND contains(doc_text, needle) GROUP BY item, doc)"""
_Q1, _Q2, _ = X.QUOTED.replace("%d", "%s").split("%s")
_N1, _N2, _N3, _ = X.NAMED.split("%s")

SEARCH = f"s AS (SELECT id AS doc, book_slug AS book, {norm('text_ar', 'search')} AS txt FROM unit WHERE kind = 'hadith')"


def snippet(n: str) -> str:
    at, st = f"strpos(txt, '{n}')", f"greatest(strpos(txt, '{n}') - 46, 0)"
    return f"CASE WHEN {st} > 0 THEN '…' ELSE '' END || substr(txt, {st} + 1, {at} - 1 - {st} + {len(n)} + 90) || '…'"


def hits(n: str) -> str:
    return f"{SEARCH}, hits AS (SELECT doc, book, {snippet(n)} AS snippet, substr(txt, strpos(txt, '{n}'), 80) AS sig FROM s WHERE contains(txt, '{n}'))"


def escape(e: str, apostrophe: bool = False) -> str:
    out = f"coalesce({e}, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *((("''", "&#x27;"),) if apostrophe else ())):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def digits(e: str) -> str:
    return f"translate({e}::VARCHAR, '0123456789', '{X.ARABIC_DIGITS}')"


def rules(e: str, table: tuple) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({e}, '{p}') THEN '{c}'" for p, c in table) + " ELSE 'na' END"


def white_trim(e: str) -> str:
    return f"regexp_replace({e}, '^[{X.WHITE}]+|[{X.WHITE}]+$', '', 'g')"


def filled(e: str) -> str:
    return f"nullif({white_trim(e)}, '')"


PARTS = f"""p AS (SELECT id, text_ar, string_split(text_ar, '،') AS parts FROM unit),
f AS (SELECT *, list_transform(parts, lambda x: regexp_matches(regexp_replace(x, '{isnad.STRIPPED}', '', 'g'), '{java(isnad.LINK)}')) AS flags FROM p),
k AS (SELECT *, CASE WHEN list_contains(flags, false) THEN list_position(flags, false) - 1 ELSE len(parts) END AS n FROM f),
m AS (SELECT *, {white_trim("coalesce(array_to_string(parts[n+1:], '،'), '')")} AS rest FROM k)"""
CHAIN = f"""src AS (SELECT id, regexp_split_to_array(regexp_replace(text_ar, '{isnad.TAIL}', ''), '{java(isnad.VERB)}') AS pieces FROM unit WHERE kind = 'hadith'),
cut AS (SELECT id, list_filter(list_transform(pieces[2:], lambda x: {white_trim(f"regexp_replace({white_trim(f'''regexp_replace(x, '{isnad.TAIL}', '')''')}, '{java(isnad.SAID)}', '')")}), lambda x: x <> '') AS names FROM src)"""
SECTIONS = "sections AS (SELECT book_slug AS book, floor(hadith_no / 100)::INT AS section, count(*) AS texts FROM unit WHERE kind = 'hadith' GROUP BY 1, 2)"
NARRATORS = "narrators AS (SELECT rawi AS key, count(*) AS c FROM grading WHERE rawi IS NOT NULL GROUP BY 1)"
RANK = "CASE method WHEN 'quotation' THEN 0 WHEN 'naming' THEN 1 WHEN 'manual' THEN 2 ELSE 9 END"
RANKED = f"""ranked AS (SELECT l.from_unit, row_number() OVER (PARTITION BY l.from_unit ORDER BY l.ambiguous, {RANK}, u.book_slug NULLS FIRST, coalesce(u.hadith_no, 0), l.id) AS place,
l.id, l.to_unit, s.name_ar AS source_name, l.method, l.ambiguous FROM link l JOIN unit u ON u.id = l.to_unit JOIN sources s ON s.id = u.source_id WHERE u.kind = 'hadith')"""
FIRST_LINKS = "SELECT * FROM link {where} QUALIFY row_number() OVER (PARTITION BY from_unit, to_unit, relation, method ORDER BY ingested_at, id) = 1"

SQL: dict[str, str] = {
    "norm_link_units": f"SELECT id, {norm('text_ar')} AS norm FROM unit",
    "norm_search_units": f"SELECT id, {norm('text_ar', 'search')} AS norm FROM unit",
    "norm_latin_docs": f"SELECT doc_id, {norm('text', 'latin')} AS norm FROM documents",
    "tokens_count": f"SELECT id, len({words(norm('text_ar'))})::INT AS n_tokens FROM unit",
    "word_windows": f"WITH {ITEMS} SELECT item AS id, (i - 1)::INT AS place, list_aggregate(w[i:i+{MIN_WORDS - 1}], 'string_agg', ' ') AS run FROM items, range(1, len(w) - {MIN_WORDS} + 2) t(i)",
    "probe_tail9": f"SELECT id, coalesce(list_aggregate({words(norm('text_ar'))}[-9:], 'string_agg', ' '), '') AS probe FROM unit WHERE kind = 'hadith'",
    "quotation_links": f"WITH {ITEMS}, {DOCS}, {QUOTES} SELECT *, row_number() OVER (PARTITION BY item ORDER BY quoted_words DESC, doc) AS place FROM quotes",
    "ambiguous_links": f"WITH {ITEMS}, {DOCS}, {QUOTES}, {ALSO} SELECT item, quoted, also FROM also",
    "naming_links": f"WITH {DOCS}, {TITLES} SELECT * FROM names",
    "merged_links": f"""WITH {ITEMS}, {DOCS}, {QUOTES}, {ALSO}, {TITLES}
SELECT q.item, q.doc, 'quotation' AS method, q.quoted AS phrase, a.also IS NOT NULL AS ambiguous, coalesce(a.also, '') AS shared_with,
'{_Q1}' || quoted_words || '{_Q2}' || q.quoted || '{X.QUOTED.split("%s")[1]}' || CASE WHEN a.also IS NULL THEN '' ELSE '{X.ALSO_BEFORE}' || a.listed || '{X.ALSO_AFTER}' END AS evidence_ar
FROM quotes q LEFT JOIN also a ON a.item = q.item AND a.quoted = q.quoted
UNION ALL SELECT n.item, n.doc, 'naming', n.named, false, '', '{_N1}' || n.named || '{_N2}' || '' || '{_N3}' || '' || ')' FROM names n WHERE NOT EXISTS (SELECT 1 FROM quotes q WHERE q.item = n.item AND q.doc = n.doc)""",
    "shared_key_links": """SELECT a.id AS from_unit, t.id AS to_unit, 'ayah_tafsir' AS relation, 'shared_key' AS method,
'مبوَّب على الآية نفسها في ' || t.edition || ' — مفتاح مشترك ' || a.surah || ':' || a.ayah || '.' AS evidence_ar
FROM unit a JOIN unit t ON a.kind = 'ayah' AND t.kind = 'tafsir' AND a.surah = t.surah AND a.ayah = t.ayah""",
    "ingest_report": """SELECT l.from_unit, count(*) FILTER (relation = 'ayah_tafsir') AS tafsirs, count(*) FILTER (relation = 'ayah_hadith') AS links, count(DISTINCT CASE WHEN relation = 'ayah_hadith' THEN to_unit END) AS hadiths,
coalesce(any_value(g.n), 0) AS gradings FROM link l LEFT JOIN (SELECT d.from_unit, count(*) AS n FROM (SELECT DISTINCT from_unit, to_unit FROM link WHERE relation = 'ayah_hadith') d JOIN grading ON unit_id = to_unit GROUP BY 1) g ON g.from_unit = l.from_unit GROUP BY 1""",
    "page_hadiths": f"WITH {RANKED} SELECT * FROM ranked",
    "page_tafsirs": "SELECT l.from_unit, row_number() OVER (PARTITION BY l.from_unit ORDER BY u.edition, l.to_unit, l.id) AS place, l.to_unit, u.edition, s.name_ar AS source_name FROM link l JOIN unit u ON u.id = l.to_unit JOIN sources s ON s.id = u.source_id WHERE u.kind = 'tafsir'",
    "page_rulings": f"""WITH {RANKED} SELECT from_unit, place, to_unit, ruling_place, ruling FROM ranked LEFT JOIN (SELECT unit_id, id AS ruling, row_number() OVER (PARTITION BY unit_id ORDER BY muhaddith, id) AS ruling_place FROM grading) g ON unit_id = to_unit""",
    "nested_pages": f"""SELECT u.id, u.surah, u.ayah, count(l.id) FILTER (v.kind = 'tafsir') AS tafsirs, count(l.id) FILTER (v.kind = 'hadith') AS hadiths, coalesce(sum(g.n) FILTER (v.kind = 'hadith'), 0)::INT AS gradings
FROM unit u LEFT JOIN link l ON l.from_unit = u.id LEFT JOIN unit v ON v.id = l.to_unit LEFT JOIN (SELECT unit_id, count(*) AS n FROM grading GROUP BY 1) g ON g.unit_id = v.id WHERE u.kind = 'ayah' AND (u.surah, u.ayah) IN ({', '.join(map(str, VERSES))}) GROUP BY 1, 2, 3""",
    "page_counts": """SELECT u.id, s.name_ar AS source_name, count(l.id) FILTER (v.kind = 'tafsir') AS tafsirs, count(l.id) FILTER (v.kind = 'hadith') AS hadiths
FROM unit u JOIN sources s ON s.id = u.source_id LEFT JOIN link l ON l.from_unit = u.id LEFT JOIN unit v ON v.id = l.to_unit WHERE u.kind = 'ayah' GROUP BY 1, 2""",
    "disputed_flag": f"SELECT unit_id, count(*) AS rulings, count(DISTINCT {white_trim('grade')}) AS grades, count(DISTINCT {white_trim('grade')}) > 1 AS disputed FROM grading GROUP BY 1",
    "ruling_urls": "SELECT DISTINCT unit_id, url FROM grading",
    "distinct_built": "SELECT DISTINCT surah FROM unit WHERE kind = 'ayah'",
    "unbuilt_refs": "SELECT n AS surah, a::INT AS ayah FROM surahs, range(1, verse_count + 1) t(a) WHERE NOT EXISTS (SELECT 1 FROM unit u WHERE u.kind = 'ayah' AND u.surah = n AND u.ayah = a)",
    "verse_lookup": "SELECT u.surah, u.ayah, u.id, s.name_ar, u.url FROM unit u JOIN sources s ON s.id = u.source_id WHERE u.kind = 'ayah' QUALIFY row_number() OVER (PARTITION BY u.surah, u.ayah ORDER BY u.id) = 1",
    "verse_order": """WITH v AS (SELECT n AS surah, a::INT AS ayah FROM surahs, range(1, verse_count + 1) t(a)), o AS (SELECT *, lead(surah || ':' || ayah) OVER (ORDER BY surah, ayah) AS next_ref, lag(surah || ':' || ayah) OVER (ORDER BY surah, ayah) AS prev_ref FROM v) SELECT * FROM o""",
    "valid_refs": "SELECT doc_id, split_part(ref_key, ':', 1)::INT AS surah, split_part(ref_key, ':', 2)::INT AS ayah, split_part(ref_key, ':', 2)::INT BETWEEN 1 AND coalesce(verse_count, 0) AS valid FROM documents LEFT JOIN surahs ON n = split_part(ref_key, ':', 1)::INT WHERE ref_key IS NOT NULL",
    "clamped_refs": "SELECT doc_id, greatest(1, least(split_part(ref_key, ':', 2)::INT + 10, verse_count)) AS ayah FROM documents JOIN surahs ON n = split_part(ref_key, ':', 1)::INT WHERE ref_key IS NOT NULL",
    "neighbours_in_book": "SELECT id, book_slug, hadith_no, nullif(lag(hadith_no) OVER w, 0) AS prev, nullif(lead(hadith_no) OVER w, 0) AS next FROM unit WHERE kind = 'hadith' WINDOW w AS (PARTITION BY book_slug ORDER BY id)",
    "upsert_sources": "SELECT source_key AS key, id, name_ar || ' ٢' AS name_ar, homepage, pinned_ref FROM sources",
    "upsert_units": """SELECT source_id, kind, ref_key, coalesce(edition, '') AS edition, arg_min(id, (ingested_at, id)) AS id, first(surah ORDER BY ingested_at, id) AS surah, first(ayah ORDER BY ingested_at, id) AS ayah,
first(book_slug ORDER BY ingested_at, id) AS book_slug, first(hadith_no ORDER BY ingested_at, id) AS hadith_no, last(text_ar ORDER BY ingested_at, id) AS text_ar, last(url ORDER BY ingested_at, id) AS url FROM unit GROUP BY 1, 2, 3, 4""",
    "insert_links": f"SELECT id, from_unit, to_unit, relation, method, evidence_ar FROM ({FIRST_LINKS.format(where='')})",
    "insert_gradings": """SELECT id, unit_id, muhaddith, book, page, grade FROM grading WHERE page IS NULL
UNION ALL SELECT id, unit_id, muhaddith, book, page, grade FROM (SELECT * FROM grading WHERE page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id, muhaddith, book, page, grade ORDER BY ingested_at, id) = 1)""",
    "reingest_links": f"SELECT id, from_unit, to_unit, relation, method FROM ({FIRST_LINKS.format(where='')})",
    "check_rejects": "SELECT l.id, u.id IS NOT NULL AS stored FROM link l LEFT JOIN unit u ON u.id = l.to_unit AND u.kind = 'hadith'",
    "unavailable_report": "SELECT row_number() OVER (ORDER BY seq) AS place, source FROM (SELECT split_part(concat_ws(':', book_slug, edition, ref_key), ':', 1) AS source, min(id) AS seq FROM unit GROUP BY 1)",
    "search_top": f"WITH {hits(NEEDLE)} SELECT * FROM hits ORDER BY book, doc LIMIT 60",
    "search_all": f"WITH {hits(NEEDLE)} SELECT * FROM hits",
    "search_scoped": f"WITH {hits(NEEDLE)} SELECT doc, snippet FROM hits WHERE book = '{SCOPE}'",
    "search_groups": f"WITH {hits(NEEDLE)} SELECT substr(coalesce(nullif(sig, ''), snippet), 1, 60) AS key, arg_min(snippet, (book, doc)) AS snippet, arg_min(doc, (book, doc)) AS first_doc, count(*) AS n FROM hits GROUP BY 1",
    "search_members": f"WITH {hits(NEEDLE)} SELECT doc, substr(coalesce(nullif(sig, ''), snippet), 1, 60) AS key FROM hits",
    "search_statistics": f"WITH {hits(NEEDLE)} SELECT count(DISTINCT substr(coalesce(nullif(sig, ''), snippet), 1, 60)) AS groups, count(*) AS hits FROM hits",
    "quick_hits": f"""WITH {SECTIONS}, k AS (SELECT *, row_number() OVER (ORDER BY slug) AS nth FROM books), b AS (SELECT 0 AS branch, n AS pos, 'سورة' AS kind, 'سورة ' || ar AS title, rev || ' · ' || {digits('verse_count')} || ' آية' AS sub, 'tafsir.html#/' || n AS href, [ar] AS hay FROM surahs
UNION ALL SELECT 1, row_number() OVER (ORDER BY edition), 'تفسير', 'تفسير في ' || edition, '', 'tafsir.html#/1/' || edition || '/1', ['تفسير في ' || edition] FROM (SELECT DISTINCT edition FROM unit WHERE kind = 'tafsir')
UNION ALL SELECT 2, nth * 1000000, 'كتاب', ar, coalesce(author, ''), 'hadith.html#/' || slug, [ar, coalesce(author, '')] FROM k
UNION ALL SELECT 2, nth * 1000000 + section + 1, 'باب', 'باب في ' || {digits('section')}, ar, 'hadith.html#/' || slug || '/' || section || '/1', ['باب في ' || {digits('section')}] FROM sections JOIN k ON slug = book)
SELECT kind, title, sub, href FROM (SELECT DISTINCT branch, pos, kind, title, sub, href FROM (SELECT *, unnest(hay) AS h FROM b) WHERE contains({norm('h', 'search')}, '{QUICK}')) ORDER BY branch, pos LIMIT 40""",
    "section_page": f"""WITH r AS (SELECT id, substr(text_ar, 1, 220) || '…' AS preview, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS c FROM unit WHERE kind = 'hadith' AND book_slug = '{SCOPE}' AND floor(hadith_no / 1000) = 1)
SELECT id, preview, greatest(1, ceil(c / 15))::INT AS pages, ceil(n / 15)::INT AS page, ((n - 1) % 15 + 1)::INT AS place FROM r""",
    "other_commentaries": "SELECT a.id, b.id AS other FROM unit a JOIN unit b ON a.kind = 'tafsir' AND b.kind = 'tafsir' AND a.surah = b.surah AND a.ayah = b.ayah AND a.edition <> b.edition",
    "verses_with_commentary": f"SELECT a.id, a.surah, a.ayah, a.text_ar, t.text_ar AS commentary FROM unit a JOIN unit t ON a.kind = 'ayah' AND t.kind = 'tafsir' AND t.edition = '{EDITION}' AND a.surah = t.surah AND a.ayah = t.ayah",
    "routes": "SELECT doc_id, 'ayah' AS kind, split_part(ref_key, ':', 1)::INT AS surah, split_part(ref_key, ':', 2)::INT AS ayah FROM documents WHERE ref_key IS NOT NULL",
    "highlighted": f"WITH {hits(NEEDLE)} SELECT doc, {escape(f'''substr(snippet, 1, strpos(snippet, '{NEEDLE}') - 1)''')} || '<mark>{NEEDLE}</mark>' || {escape(f'''substr(snippet, strpos(snippet, '{NEEDLE}') + {len(NEEDLE)})''')} AS html FROM hits",
    "escaped_docs": f"SELECT doc_id, {escape('text')} AS js, {escape('text', True)} AS py FROM documents",
    "previews": "SELECT id, substr(text_ar, 1, 220) || '…' AS preview FROM unit WHERE kind = 'hadith'",
    "arabic_numbers": f"SELECT o_orderkey, {digits('o_orderkey')} AS digits FROM orders",
    "paragraph_rows": f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {white_trim('x')}), lambda x: x <> '') AS p FROM documents), q AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE ['—'] END AS p FROM l)
SELECT doc_id, (i - 1)::INT AS place, p[i] AS paragraph FROM q, range(1, len(p) + 1) t(i)""",
    "paging_15": "WITH r AS (SELECT id, book_slug, row_number() OVER (PARTITION BY book_slug ORDER BY id) AS n, count(*) OVER (PARTITION BY book_slug) AS c FROM unit WHERE kind = 'hadith') SELECT id, book_slug, greatest(1, ceil(c / 15))::INT AS pages, ceil(n / 15)::INT AS page, ((n - 1) % 15 + 1)::INT AS place FROM r",
    "narrators_page_2": f"WITH {NARRATORS} SELECT * FROM narrators ORDER BY c DESC, key LIMIT 36 OFFSET 36",
    "narrators_top60": f"WITH {NARRATORS} SELECT * FROM narrators ORDER BY c DESC, key LIMIT 60",
    "catalogue_totals": f"WITH {SECTIONS} SELECT count(DISTINCT book) AS books, sum(texts)::BIGINT AS texts, count(*) AS sections FROM sections",
    "section_names": f"WITH {SECTIONS} SELECT u.id, CASE WHEN s.texts > 2 THEN concat_ws(' ', s.book, s.section) ELSE '' END AS section_name FROM unit u JOIN sections s ON s.book = u.book_slug AND s.section = floor(u.hadith_no / 100)::INT WHERE u.kind = 'hadith'",
    "picked_books": f"WITH {SECTIONS}, c(pos, book, section) AS (VALUES {', '.join(map(str, PICKS))}) SELECT pos, book, section, texts FROM c JOIN sections USING (book, section)",
    "narrator_refs": """WITH h AS (SELECT DISTINCT rawi AS key, book_slug, hadith_no FROM grading JOIN unit u ON u.id = unit_id AND u.kind = 'hadith' WHERE rawi IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY book_slug, hadith_no) - 1 AS pos, count(*) OVER (PARTITION BY key) AS total FROM h)
SELECT key, pos::INT AS pos, hadith_no AS number, coalesce(b.ar, book_slug) AS book_name, total FROM r LEFT JOIN books b ON b.slug = book_slug AND b.author IS NOT NULL WHERE pos < 90""",
    "ruling_facts": "SELECT id, 0 AS pos, 'الراوي' AS label, rawi AS value FROM grading WHERE rawi <> '' UNION ALL SELECT id, 1, 'الصفحة', page FROM grading WHERE page <> '' UNION ALL SELECT id, 2, 'الشرح', explanation FROM grading WHERE explanation <> ''",
    "split_chains": f"WITH {PARTS} SELECT id, CASE WHEN len(parts) > 1 AND n > 0 AND n < len(parts) AND rest <> '' THEN {white_trim('''array_to_string(parts[1:n], '،') || '،' ''')} END AS isnad, CASE WHEN len(parts) > 1 AND n > 0 AND n < len(parts) AND rest <> '' THEN rest ELSE text_ar END AS matn FROM m",
    "chain_names": f"WITH {CHAIN} SELECT id, (i - 1)::INT AS place, names[i] AS name FROM cut, range(1, len(names) + 1) t(i)",
    "chain_members": f"""WITH {CHAIN}, l AS (SELECT id AS doc, i - 1 AS pos, names[i] AS value FROM cut, range(1, len(names) + 1) t(i)), x AS (SELECT rawi AS key, min(grade) AS g FROM grading WHERE rawi IS NOT NULL GROUP BY 1),
j AS (SELECT doc, pos, value AS name, CASE WHEN pos = 0 THEN g ELSE '' END AS sub FROM l LEFT JOIN x ON pos = 0 AND key = value WHERE pos > 0 OR key IS NOT NULL)
SELECT doc, name, sub, row_number() OVER (PARTITION BY doc ORDER BY pos) AS nth, row_number() OVER (PARTITION BY doc ORDER BY pos) = count(*) OVER (PARTITION BY doc) AS last FROM j""",
    "grade_classes": f"SELECT id, {rules(norm('grade', 'search'), classify.GRADES)} AS class FROM grading",
    "narrator_classes": f"SELECT id, {rules(norm('grade', 'search'), classify.NARRATORS)} AS class FROM grading",
    "generation_labels": "SELECT * FROM (VALUES (0, 'صحابي'), (1, 'تابعي — الطبقة الثانية Generation]'), (2, 'تابعي'), (3, 'Succ. (Taba'' تابعي)'), (4, 'من القرن 3 الهجري'), (5, 'الطبقة 12'), (6, 'the النبي ﷺ'), (7, 'تابعي'), (8, 'unknown'), (9, ''), (10, '')) t(pos, label)",
    "method_labels": "SELECT id, CASE method " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.METHOD_LABELS.items()) + " ELSE method END AS label FROM link",
    "shared_with_text": "SELECT id, CASE WHEN len(shared_with) > 0 THEN array_to_string(shared_with, ',') END AS shared_with FROM link",
    "ref_parts": "SELECT id, split_part(ref_key, ':', 1)::INT AS s, split_part(ref_key, ':', 2)::INT AS a FROM unit WHERE kind <> 'hadith'",
    "page_dashes": "SELECT id, coalesce(nullif(page, ''), '—') AS page FROM grading",
    "hadith_scan": "SELECT u.id, coalesce(b.ar, u.book_slug) || ' — حديث رقم ' || u.hadith_no AS locus_ar FROM unit u LEFT JOIN books b ON b.slug = u.book_slug WHERE u.hadith_no IS NOT NULL AND length(u.text_ar) > 0",
    "surah_metadata": "SELECT n, ar, rev, verse_count FROM surahs",
    "json_rulings": f"SELECT id, {white_trim('muhaddith')} AS muhaddith, {white_trim('book')} AS book, {filled('page')} AS page, {white_trim('grade')} AS grade, {filled('explanation')} AS explanation, {filled('rawi')} AS rawi FROM grading WHERE {white_trim('muhaddith')} <> '' AND {white_trim('grade')} <> ''",
    "html_rulings": f"SELECT id, {white_trim(escape('muhaddith'))} AS muhaddith, {filled(escape('page'))} AS page, {white_trim(escape('grade'))} AS grade, {filled(escape('rawi'))} AS rawi FROM grading WHERE {white_trim('muhaddith')} <> '' AND {white_trim('grade')} <> ''",
    "json_events": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "cache_keys": "SELECT url, substr(sha256(url), 1, 32) AS key FROM (SELECT DISTINCT url FROM unit)",
    "quoted_urls": "SELECT id, replace(url_encode(muhaddith), '%2F', '/') AS quoted FROM grading",
    "mirrors": "SELECT slug, coalesce(nullif(author, ''), ar) AS answer FROM books",
    "shards": """SELECT muhaddith, (abs(list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(muhaddith, ''), lambda x: x <> ''), lambda x: ord(x)::BIGINT)), lambda a, b: (((a * 31 + b + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648)) % 24)::INT AS shard FROM (SELECT DISTINCT muhaddith FROM grading)""",
    "edition_names": "SELECT id, CASE edition " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in readers.EDITION_NAMES.items()) + " ELSE edition END || ' — عند ' || ref_key AS locus_ar FROM unit WHERE kind = 'tafsir'",
}

