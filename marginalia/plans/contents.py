"""Named queries of contents pages, front pages, manifests and plans of issues, each beside its SQL.

Issues are those of ``plans.segments``. Page 1 of an issue is its cover with the contents: it lists the first sentence of every document, one part of a
sentence a line, and the page number printed on the document's page, which follows in order. The tables have no such pages, so they are put together from whole texts here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import contents as C
from marginalia.operators import frontpages as P
from marginalia.operators import issues as I  # noqa: E741
from marginalia.plans.registry import query
from marginalia.plans.segments import _ISSUES_SQL, issues
from marginalia.sources.tables import table

ABOUT, OWN, HOUSE, ACRONYMS = "about the review", "the review", "The Review", ("gdp", "ups", "r&d")
PRINTED = 3  # printed numbers are so far ahead of pages
LABELS = {"en": "COVER STORY:", "fr": "Consumers’ Desk", "es": "* not in this issue"}
STRAPS = ("Editorial", "Cover  Article", "Feature Articles:", None, "About the Review")

_issues = _ISSUES_SQL.replace("WITH RECURSIVE", "WITH")
_CASE = lambda x, pairs: f"CASE {x} " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs) + " END"
_PAGES_SQL = f"""{_issues},
    own AS (SELECT *, split_part(split_part(text, chr(10), 1), '.', 1) AS title, split_part(text, ' ', 1) AS word FROM d),
    pg AS (SELECT issue, entry + 1 AS page, doc_id, concat_ws(chr(10), {_CASE('doc_id % 5', [(k, f"'{s}'") for k, s in enumerate(STRAPS) if s])}, title,
      CASE doc_id % 4 WHEN 0 THEN '-Mr ' || word WHEN 1 THEN 'Director of works' || chr(10) || 'Dr. ' || word END, text, CASE WHEN lang <> 'fr' THEN (entry + 1 + {PRINTED})::VARCHAR END) AS text FROM own
    UNION ALL SELECT issue, 1, NULL, concat_ws(chr(10), CASE WHEN min(doc_id) % 4 <> 3 THEN 'Volume II, Issue ' || (min(doc_id) // 200) END, 'The Review of ' || any_value(split_part(issue, '-', 1)), 'Nov.-Dec. 2021', CASE WHEN min(doc_id) % 3 > 0 THEN 'Table of Content' END,
      string_agg(concat_ws(chr(10), {_CASE('lang', [(f"'{k}'", f"'{v}'") for k, v in LABELS.items()])}, replace(title, ', ', ',' || chr(10)) || '   ' || (entry + 1 + {PRINTED})), chr(10) ORDER BY entry)) FROM own GROUP BY issue),
    sz AS (SELECT issue, count(*) AS pages FROM pg GROUP BY issue)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """issue, page, doc_id (null for the cover), text."""
    rows = issues(spark, d).withColumns({"title": F.substring_index(T.first_line(F.col("text")), ".", 1), "word": F.substring_index("text", " ", 1), "printed": (F.col("entry") + 1 + PRINTED).cast("string")})
    n = F.col("doc_id")
    strap = F.get(F.array(*(F.lit(s) for s in STRAPS)), (n % 5).cast("int"))
    byline = F.when(n % 4 == 0, F.concat(F.lit("-Mr "), "word")).when(n % 4 == 1, F.concat(F.lit("Director of works\nDr. "), "word"))
    own = rows.select("issue", (F.col("entry") + 1).alias("page"), "doc_id", F.concat_ws("\n", strap, "title", byline, "text", F.when(F.col("lang") != "fr", F.col("printed"))).alias("text"))
    label = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in LABELS.items()))
    listed = F.concat_ws("\n", label, F.concat(F.replace("title", F.lit(", "), F.lit(",\n")), F.lit("   "), "printed"))
    covers = rows.select("issue", "entry", "doc_id", listed.alias("listed")).groupBy("issue").agg(F.min("doc_id").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", "listed"))), lambda x: x.listed), "\n").alias("listed"))
    volume = F.when(F.col("n") % 4 != 3, F.concat(F.lit("Volume II, Issue "), F.expr("n div 200").cast("string")))
    text = F.concat_ws("\n", volume, F.concat(F.lit("The Review of "), F.split_part("issue", F.lit("-"), F.lit(1))), F.lit("Nov.-Dec. 2021"), F.when(F.col("n") % 3 > 0, "Table of Content"), "listed")
    return own.unionByName(covers.select("issue", F.lit(1).cast("long").alias("page"), F.lit(None).cast("long").alias("doc_id"), text.alias("text")))


_SPACE = "[\\s\\x0B\\x{85}\\p{Z}]"
_TIDY = lambda x: f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"
_ENDS = lambda x: f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_LABEL = lambda x: _CASE(f"CASE WHEN length({_key(x)}) <= 40 THEN {_key(x)} END", [(f"'{k.replace(chr(39), chr(39) * 2)}'", f"'{v}'") for k, v in {ABOUT: C.ABOUT, **C.SECTIONS}.items()])
_key = lambda x: f"replace(lower(regexp_replace({_TIDY(x)}, '[.:]+$', '')), '’', '''')"
_FOLIO = lambda x: f"TRY_CAST(nullif(regexp_extract({x}, '^(.*?)\\s+([0-9]{{1,3}})$', 2), '') AS BIGINT)"
_CONTENTS_SQL = f"""{_PAGES_SQL},
    hd AS (SELECT issue, page, pages, regexp_matches(text, 'table of contents?', 'i') AS marked, len(list_filter(string_split(text, chr(10)), lambda x: coalesce({_FOLIO(_ENDS('x'))} BETWEEN 1 AND pages, false))) AS listed FROM pg JOIN sz USING (issue) WHERE page <= 4),
    loc AS (SELECT issue, any_value(pages) AS pages, coalesce(min(page) FILTER (WHERE marked), min(page) FILTER (WHERE listed >= 3)) AS contents_page, bool_or(marked) AS had_marker FROM hd GROUP BY issue),
    region AS (SELECT issue, any_value(pages) AS pages, any_value(had_marker) AS had_marker, string_agg(text, chr(10) ORDER BY page) AS text FROM pg JOIN loc USING (issue) WHERE page BETWEEN contents_page AND contents_page + 1 GROUP BY issue),
    ls AS (SELECT issue, pages, string_split(CASE WHEN had_marker THEN array_to_string(regexp_split_to_array(text, '(?i)table of contents?')[2:], chr(10)) ELSE text END, chr(10)) AS l FROM region),
    li AS (SELECT issue, pages, generate_subscripts(l, 1) AS n, {_ENDS('unnest(l)')} AS line FROM ls),
    lb AS (SELECT *, {_LABEL('line')} AS label FROM li WHERE line <> '' AND line[1] <> '*'),
    an AS (SELECT *, CASE WHEN label IS NULL AND {_FOLIO('line')} BETWEEN 1 AND pages THEN {_FOLIO('line')} END AS folio FROM lb),
    gr AS (SELECT *, sum(CASE WHEN label IS NOT NULL OR folio IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY issue ORDER BY n) AS upto, last_value(label IGNORE NULLS) OVER (PARTITION BY issue ORDER BY n) AS section FROM an),
    bf AS (SELECT issue, upto + 1 AS upto, list(line ORDER BY n) AS buffer FROM gr WHERE label IS NULL AND folio IS NULL GROUP BY issue, upto),
    en AS (SELECT gr.issue, n, section, folio, regexp_extract(line, '^(.*?)\\s+([0-9]{{1,3}})$', 1) AS own, coalesce(buffer, []) AS buffer FROM gr LEFT JOIN bf USING (issue, upto) WHERE folio IS NOT NULL),
    ti AS (SELECT issue, n, coalesce({_LABEL('own')}, section, 'Feature Article') AS section, left({_TIDY("array_to_string(list_append(buffer[-2:], own), ' ')")}, 160) AS title, folio FROM en),
    entries AS (SELECT issue, row_number() OVER (PARTITION BY issue ORDER BY n) AS entry, section, title, folio FROM ti WHERE length(title) >= 3)"""


@query(_CONTENTS_SQL + " SELECT * FROM entries")
def contents_entries(spark: SparkSession, d: str) -> DataFrame:
    return C.contents_entries(_pages(spark, d).select("issue", "page", "text"), ABOUT)


_RANGES_SQL = f"""{_CONTENTS_SQL},
    mg AS (SELECT issue, page, list_filter(string_split(text, chr(10)), lambda x: {_ENDS('x')} <> '') AS l FROM pg),
    vt AS (SELECT issue, page, {_ENDS("list_filter(list_concat(l[1:2], l[-2:]), lambda x: regexp_matches(x, '^\\s*[0-9]{1,3}\\s*$'))[1]")}::BIGINT - page AS v FROM mg),
    ct AS (SELECT issue, v, count(*) AS times, min(page) AS first FROM vt WHERE v IS NOT NULL GROUP BY issue, v),
    fo AS (SELECT issue, v AS shift, times, sum(times) OVER (PARTITION BY issue)::BIGINT AS observed FROM ct QUALIFY row_number() OVER (PARTITION BY issue ORDER BY times DESC, first) = 1),
    st AS (SELECT e.*, folio - coalesce(shift, 0) AS start_page, sz.pages FROM entries e JOIN sz USING (issue) LEFT JOIN fo USING (issue) WHERE folio - coalesce(shift, 0) BETWEEN 1 AND sz.pages),
    nx AS (SELECT *, row_number() OVER w - 1 AS index, lead(start_page) OVER w AS nxt FROM st WINDOW w AS (PARTITION BY issue ORDER BY start_page, entry)),
    rg AS (SELECT *, CASE WHEN nxt IS NULL THEN pages ELSE greatest(start_page, nxt - 1) END AS stop, nxt IS NULL AND pages - start_page + 1 > 25 AS cut FROM nx),
    ranges AS (SELECT issue, index, section, title, start_page, CASE WHEN cut THEN start_page + 24 ELSE stop END AS end_page, CASE WHEN cut THEN stop END AS capped_from, lower(section) IN ('{ABOUT}', 'about') OR lower(title) IN ('{ABOUT}', 'about') AS skip FROM rg)"""


@query(_RANGES_SQL + " SELECT * FROM ranges")
def contents_ranges(spark: SparkSession, d: str) -> DataFrame:
    return C.article_ranges(_pages(spark, d).select("issue", "page", "text"), ABOUT)


_PERIOD = C.PERIOD.replace("'", "''")


@query(_RANGES_SQL + f""",
    fi AS (SELECT issue, CASE WHEN min(doc_id) % 2 = 0 THEN 'V3_I' || (min(doc_id) // 200) || ' scan' ELSE 'scan' END AS file_name, CASE WHEN min(doc_id) % 7 = 0 THEN 'Volume 4' ELSE 'Volume 2' END AS folder FROM d GROUP BY issue),
    tx AS (SELECT issue, string_agg(text, chr(10) ORDER BY page) AS text, string_agg(CASE WHEN page = 1 THEN text END, '') AS cover FROM pg WHERE page <= 3 GROUP BY issue),
    cf AS (SELECT issue, cover, text, CASE WHEN regexp_matches(text, '{C.COVER}') THEN CASE upper(regexp_extract(text, '{C.COVER}', 1)) WHEN 'II' THEN 2 ELSE NULL END END AS cv, TRY_CAST(nullif(regexp_extract(text, '{C.COVER}', 2), '') AS BIGINT) AS ci,
      TRY_CAST(nullif(regexp_extract(file_name, '{C.FILE_NAME}', 1), '') AS BIGINT) AS nv, TRY_CAST(nullif(regexp_extract(file_name, '{C.FILE_NAME}', 2), '') AS BIGINT) AS ni, regexp_extract(folder, '[0-9]+')::BIGINT AS fv FROM fi JOIN tx USING (issue)),
    tl AS (SELECT issue, list_transform(string_split(cover, chr(10)), lambda x: {_ENDS('x')}) AS l FROM cf),
    tm AS (SELECT issue, CASE WHEN len(list_filter(l, lambda x: regexp_matches(x, 'table of contents', 'i'))) > 0 THEN l[:list_position(list_transform(l, lambda x: regexp_matches(x, 'table of contents', 'i')), true) - 1] ELSE l END AS l FROM tl),
    tt AS (SELECT issue, nullif({_TIDY("array_to_string(list_filter(l, lambda x: length(x) > 3 AND NOT regexp_matches(x, '" + OWN + "', 'i') AND NOT regexp_matches(x, 'volume|issue', 'i') AND NOT regexp_matches(x, '" + _PERIOD + "') AND NOT regexp_matches(x, '^[0-9]+$'))[1:3], ' ')")}, '') AS cover_title FROM tm),
    lg AS (SELECT issue, count(*) AS articles, coalesce(list((CASE WHEN capped_from IS NOT NULL THEN 'capped: ' ELSE 'long: ' END) || title ORDER BY index) FILTER (WHERE capped_from IS NOT NULL OR (NOT skip AND end_page - start_page > 24)), []) AS longs FROM ranges GROUP BY issue),
    ec AS (SELECT issue, count(*) AS entries FROM entries GROUP BY issue),
    al AS (SELECT *, coalesce(articles, 0) AS arts, coalesce(entries, 0) AS ents, coalesce(observed, 0) AS obs, CASE WHEN cv IS NOT NULL THEN coalesce(fv, nv, cv) ELSE coalesce(nv, fv) END AS volume, coalesce(ni, ci) AS number,
      CASE WHEN regexp_matches(text, '{_PERIOD}') THEN trim(regexp_replace(regexp_extract(text, '{_PERIOD}', 1), '\\s+', '', 'g') || ' ' || regexp_extract(text, '{_PERIOD}', 2)) END AS period
      FROM cf JOIN tt USING (issue) JOIN loc USING (issue) LEFT JOIN fo USING (issue) LEFT JOIN lg USING (issue) LEFT JOIN ec USING (issue)),
    wa AS (SELECT *, list_filter(list_concat([CASE WHEN nv <> cv THEN 'cover has volume ' || cv || ', file name has ' || nv END, CASE WHEN cv IS NOT NULL AND coalesce(nv, cv) <> fv THEN 'cover has volume ' || coalesce(nv, cv) || ', folder has ' || fv END,
      CASE WHEN ni <> ci THEN 'cover has issue ' || ci || ', file name has ' || ni END, CASE WHEN volume IS NULL THEN 'no volume' END, CASE WHEN number IS NULL THEN 'no issue number' END, CASE WHEN period IS NULL THEN 'no period' END,
      CASE WHEN contents_page IS NULL THEN 'no contents' WHEN NOT had_marker THEN 'contents without heading on page ' || contents_page END, CASE WHEN ents = 0 THEN 'no entries' END,
      CASE WHEN obs < 5 THEN 'page numbers on ' || obs || ' pages' WHEN times / obs < 0.7 THEN 'page numbers agree on ' || floor(times / obs * 100 + 0.5)::BIGINT || ' %' END,
      CASE WHEN arts > 0 AND arts < ents THEN 'outside the pages: ' || (ents - arts) END], coalesce(longs, [])), lambda x: x IS NOT NULL) AS warnings FROM al)
    SELECT issue, volume, number, period, cover_title, pages, coalesce(shift, 0) AS "offset", CASE WHEN obs > 0 THEN round(times / obs, 2) ELSE 0 END AS agreement, arts AS articles, array_to_string(warnings, '; ') AS warnings, CASE WHEN len(warnings) = 0 THEN 'ok' ELSE 'review' END AS confidence FROM wa""")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    n = F.min("doc_id")
    files = pages.groupBy("issue").agg(
        F.when(n % 2 == 0, F.concat(F.lit("V3_I"), F.floor(n / 200).cast("string"), F.lit(" scan"))).otherwise("scan").alias("file_name"), F.when(n % 7 == 0, "Volume 4").otherwise("Volume 2").alias("folder")
    )
    out = C.manifests(pages.select("issue", "page", "text"), files, ABOUT, OWN)
    return out.withColumn("warnings", F.array_join("warnings", "; "))


_BYLINE = lambda x: f"""(length({x}) <= 70 AND NOT regexp_matches({x}, '[?!:;]$') AND (regexp_matches({x}, '{I.BYLINE_PREFIX}', 'i') OR (regexp_matches({x}, '[a-z]') AND NOT regexp_matches({x}, '{I.NOT_A_NAME}', 'i')
    AND len(list_filter(string_split(regexp_replace({x}, '[.,]', '', 'g'), ' '), lambda w: w <> '')) BETWEEN 2 AND 5 AND len(list_filter(string_split(regexp_replace({x}, '[.,]', '', 'g'), ' '), lambda w: w <> '' AND NOT regexp_matches(w, '^[A-Z]'))) = 0)))"""  # noqa: E731
_BARE = lambda x: f"trim(regexp_replace(regexp_split_to_array(regexp_replace({x}, '{I.BYLINE_PREFIX}', '', 'i'), '\\s*[,.]\\s+')[1], '[.,;:]+$', ''))"
_NAME = lambda x: f"CASE WHEN length({_BARE(x)}) BETWEEN 1 AND 60 AND len(list_filter(string_split({_BARE(x)}, ' '), lambda w: w <> '')) <= 6 AND NOT regexp_matches({_BARE(x)}, '{I.NOT_A_NAME}', 'i') THEN {_BARE(x)} END"
_MASTHEAD = " OR ".join(f"regexp_matches(line, '{x}', 'i')" for x in (*P.MASTHEAD, f"^{OWN}"))
_STRAP = "CASE WHEN length(k) > 30 THEN NULL " + " ".join(f"WHEN regexp_matches(k, '{p.replace(chr(39), chr(39) * 2)}', 'i') THEN '{v}'" for p, v in {f"^{ABOUT}$": "About", **P.STRAPS}.items()) + " END"
_FRONT_SQL = f"""{_PAGES_SQL},
    fl AS (SELECT issue, page, generate_subscripts(string_split(text, chr(10)), 1) AS m, trim(replace(regexp_replace(unnest(string_split(text, chr(10))), '{_SPACE}+', ' ', 'g'), chr(173), '')) AS line FROM pg),
    fm AS (SELECT issue, page, row_number() OVER (PARTITION BY issue, page ORDER BY m) AS n, line, regexp_replace(line, '[.:]+$', '') AS k FROM fl WHERE line <> '' AND NOT ({_MASTHEAD})),
    fs AS (SELECT *, {_STRAP} AS strap FROM fm),
    fa AS (SELECT issue, page, coalesce(min(n) FILTER (WHERE strap IS NOT NULL AND n <= 6), 0) AS s, max(n) AS last, arg_min(strap, n) FILTER (WHERE strap IS NOT NULL AND n <= 6) AS section FROM fs GROUP BY issue, page),
    fk AS (SELECT fs.*, s, last, section, CASE WHEN strap IS NOT NULL THEN 's' WHEN length(line) > 80 THEN 'b' WHEN {_BYLINE('line')} THEN 'y' ELSE 'h' END AS kind FROM fs JOIN fa USING (issue, page) WHERE n > s),
    fn AS (SELECT *, sum((kind = 'h')::INT) OVER (PARTITION BY issue, page ORDER BY n) AS heads FROM fk),
    fc AS (SELECT issue, page, least(coalesce(min(n) FILTER (WHERE kind IN ('b', 'y')), last + 1), coalesce(min(n) FILTER (WHERE kind = 'h' AND regexp_matches(line, '[.?!]$')) + 1, last + 1), coalesce(min(n) FILTER (WHERE heads = 4) + 1, last + 1)) AS cur FROM fn GROUP BY issue, page, last),
    fh AS (SELECT fn.issue, fn.page, string_agg(line, ' ' ORDER BY n) AS head FROM fn JOIN fc USING (issue, page) WHERE n < cur AND kind = 'h' GROUP BY fn.issue, fn.page),
    fu AS (SELECT pg.issue, pg.page, section, coalesce(section = 'Editorial', false) AS ed, nullif(trim(regexp_replace(head, '{P.BODY_OPENER}', '', 'i')), '') AS head, head IS NOT NULL AS any_head, a.line AS one, b.line AS two FROM pg LEFT JOIN fa USING (issue, page) LEFT JOIN fc USING (issue, page) LEFT JOIN fh USING (issue, page)
      LEFT JOIN fs a ON a.issue = pg.issue AND a.page = pg.page AND a.n = cur LEFT JOIN fs b ON b.issue = pg.issue AND b.page = pg.page AND b.n = cur + 1),
    fr AS (SELECT issue, page, section, ed, CASE WHEN NOT ed THEN head END AS headline, CASE WHEN NOT ed AND any_head THEN CASE WHEN one IS NULL THEN NULL WHEN {_BYLINE('one')} THEN {_NAME('one')} WHEN regexp_matches(one, '{P.AFFILIATION}', 'i') AND two IS NOT NULL AND {_BYLINE('two')} THEN {_NAME('two')} END END AS author FROM fu),
    fronts AS (SELECT issue, page, headline, author, section, coalesce(length(headline) BETWEEN 12 AND 160 AND (section IS NOT NULL OR author IS NOT NULL), false) AS confident, CASE WHEN ed THEN NULL WHEN headline IS NULL THEN 'no headline' WHEN coalesce(length(headline) BETWEEN 12 AND 160 AND (section IS NOT NULL OR author IS NOT NULL), false) THEN NULL ELSE 'unverified' END AS note FROM fr)"""


def _fronts(spark: SparkSession, d: str) -> DataFrame:
    return P.front_pages(_pages(spark, d), ["issue", "page"], "text", f"^{ABOUT}$", [f"^{OWN}"])


@query(_FRONT_SQL + " SELECT * FROM fronts")
def front_pages(spark: SparkSession, d: str) -> DataFrame:
    return _fronts(spark, d)


_SHORTS = ", ".join(f"regexp_matches(t, '{x}', 'i')" for x in I.FURNITURE)
_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)


def _clean_sql(x: str) -> str:
    for old, new in T._EXPANSIONS.items():
        x = f"replace({x}, '{old}', '{new * 2 if new == chr(39) else new}')"
    return f"nullif(trim(regexp_replace(regexp_replace({_TIDY(f'''regexp_replace({x}, '^REPRINT\\s+', '', 'i')''')}, '^[-–—\\s]+', ''), '[\\s,;:]+$', '')), '')"


def titles_sql(source: str, key: str) -> str:
    """CTEs that end in picked(key, title, source, needs_review): of ``source`` (key, front, contents, sure). The two titles of a row are tested and recased as rows of one table."""
    return f"""
    cl AS (SELECT {key}, sure, {_clean_sql('front')} AS f, {_clean_sql('contents')} AS c FROM {source}),
    tw AS (SELECT {key}, 'f' AS side, f AS t FROM cl UNION ALL SELECT {key}, 'c', c FROM cl),
    tv AS (SELECT *, regexp_split_to_array(t, '\\s+') AS w, lower(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS l FROM tw WHERE t IS NOT NULL),
    tg AS (SELECT {key}, side, t, length(t) < 8 OR list_bool_or([{_SHORTS}]) OR regexp_matches(t, '^[a-z]') OR regexp_matches(t, '\\b({I.DANGLING})$', 'i') OR length(t) > 140 OR len(w) > 22
      OR (length(l) >= 10 AND 5 * len(list_filter(range(2, length(l) + 1), lambda i: l[i] = l[i - 1])) > 2 * length(l))
      OR len(list_filter(w, lambda x: length(x) > 16 OR (length(x) > 10 AND regexp_matches(x, '[a-z][A-Z]')))) > 0
      OR (len(w) >= 8 AND len(list_filter(w[2:], lambda x: regexp_matches(x, '^[0-9]{{2,3}}$'))) > 0) OR regexp_matches(t, '{I.INNER_STRAPS}', 'i') AS bad FROM tv),
    tc AS (SELECT *, regexp_extract_all(lower(t), '[\\s–—/-]|[^\\s–—/-]+') AS w, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up FROM tg WHERE NOT bad),
    tb AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '[^a-z0-9&]', '', 'g')) AS b, list_transform(w, lambda x: length(regexp_extract(x, '^[^a-z]*'))) AS p FROM tc),
    td AS (SELECT {key}, side, t, CASE WHEN up = 0 OR 5 * low > low + up THEN t ELSE array_to_string([CASE WHEN NOT regexp_matches(w[i], '[a-z]') THEN w[i] WHEN b[i] IN ({_QUOTED(ACRONYMS)}) THEN replace(w[i], b[i], upper(b[i]))
      WHEN i > 1 AND i < len(w) AND b[i] IN ({_QUOTED(I.SMALL_WORDS)}) THEN w[i] ELSE substr(w[i], 1, p[i]) || upper(substr(w[i], p[i] + 1, 1)) || substr(w[i], p[i] + 2) END FOR i IN range(1, len(w) + 1)], '') END AS cased,
      list_distinct(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: length(x) > 3 AND x NOT IN ({_QUOTED(I.SMALL_WORDS)}))) AS ws FROM tb),
    pk AS (SELECT cl.*, f.cased AS fc, c.cased AS cc, f.ws AS x, c.ws AS y FROM cl LEFT JOIN td f ON f.{key} = cl.{key} AND f.side = 'f' LEFT JOIN td c ON c.{key} = cl.{key} AND c.side = 'c'),
    picked AS (SELECT {key}, CASE WHEN fc IS NOT NULL AND sure THEN fc WHEN cc IS NOT NULL THEN cc ELSE fc END AS title, CASE WHEN fc IS NOT NULL AND sure THEN 'front page' WHEN cc IS NOT NULL THEN 'contents' WHEN fc IS NOT NULL THEN 'front page (unverified)' ELSE 'none' END AS source,
      CASE WHEN fc IS NOT NULL AND sure THEN cc IS NOT NULL AND least(len(x), len(y)) > 0 AND len(list_intersect(x, y)) < 0.34 * least(len(x), len(y)) ELSE cc IS NULL END AS needs_review FROM pk)"""


@query("""
    WITH src AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS front, split_part(coalesce(text, ''), chr(10), 2) AS contents, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS sure FROM documents),""" + titles_sql("src", "doc_id") + " SELECT * FROM picked")  # fmt: skip
def title_choice(spark: SparkSession, d: str) -> DataFrame:
    """A document's first line stands for the headline, sure where its quality is, and the second for its entry in the contents."""
    line = lambda n: F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(n))
    sure = table(spark, d, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("sure")).distinct()
    rows = table(spark, d, "documents").join(sure, "doc_id", "left")
    return T.with_picked_title(rows, line(1), line(2), F.col("sure"), I.garbled, _recased, I.SMALL_WORDS).select("doc_id", "_picked.*")


def _recased(title: Column) -> Column:
    return I.title_case(title, ACRONYMS)


@query(_RANGES_SQL + _FRONT_SQL.removeprefix(_PAGES_SQL) + f""",
    ar AS (SELECT r.issue || '/' || r.index AS k, r.*, f.headline, f.author, f.section AS strap, f.confident FROM ranges r LEFT JOIN fronts f ON f.issue = r.issue AND f.page = r.start_page),
    src AS (SELECT k, headline AS front, title AS contents, coalesce(confident, false) AS sure FROM ar),{titles_sql('src', 'k')},
    au AS (SELECT k, {_clean_sql('author')} AS author FROM ar)
    SELECT issue, index, CASE WHEN coalesce(strap, section) = 'Editorial' THEN 'Editorial — Nov.-Dec. 2021' ELSE p.title END AS title, CASE WHEN coalesce(strap, section) = 'Editorial' THEN 'issue' ELSE p.source END AS title_source,
      coalesce(strap, section) <> 'Editorial' AND p.needs_review AS needs_review, CASE WHEN length(au.author) >= 3 THEN au.author ELSE '{HOUSE}' END AS author, CASE WHEN ar.author IS NULL THEN 'house' ELSE 'byline' END AS author_source,
      coalesce(strap, section) AS section, start_page, coalesce(capped_from, end_page) AS end_page, coalesce(capped_from, end_page) - start_page + 1 AS pages FROM ar JOIN picked p USING (k) JOIN au USING (k)""")
def article_plans(spark: SparkSession, d: str) -> DataFrame:
    """The articles of the manifests with the facts of their opening pages; every issue has one period."""
    pages = _pages(spark, d).select("issue", "page", "text")
    periods = pages.select("issue").distinct().withColumn("period", F.lit("Nov.-Dec. 2021"))
    return P.planned(C.article_ranges(pages, ABOUT), _fronts(spark, d), HOUSE, ACRONYMS, periods)


@query(_FRONT_SQL + """,
    op AS (SELECT issue, page, section AS strap, CASE WHEN length(headline) >= 15 THEN headline END AS title, confident, max(page) OVER (PARTITION BY issue) AS last FROM fronts)
    SELECT issue, page AS start_page, coalesce(lead(page) OVER (PARTITION BY issue ORDER BY page), last + 1) - 1 AS end_page, coalesce(title, strap) AS title, coalesce(strap, 'Feature Article') AS section
    FROM op WHERE page > 1 AND (strap IS NOT NULL OR (title IS NOT NULL AND confident)) AND strap IS DISTINCT FROM 'About'""")
def issue_openings(spark: SparkSession, d: str) -> DataFrame:
    """The articles of issues by what the reader of front pages finds, without their contents pages."""
    return I.openings(_fronts(spark, d), "issue", "page", "section", "headline", "confident")
