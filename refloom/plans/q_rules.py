"""Queries over values composed row by row: rules of single classes, identifiers and dates that rarely occur, sources and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions import citation as C
from refloom.functions import dates as DT
from refloom.functions import identifiers as I
from refloom.operators import citations as O
from refloom.operators import quality as Q
from refloom.plans.q_citations import _NORMAL, normalized_cites
from refloom.plans.registry import query
from refloom.session import scratch_path
from refloom.sources import dump, lists


def _orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderdate")


def _pick(k: Column, *values) -> Column:
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(k % len(values) == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])




def _k() -> Column:
    return F.col("k")


_N = "CAST(k AS VARCHAR)"
_KEYS = "(SELECT o_orderkey AS k, o_orderdate FROM orders) o"


# --- identifiers, dates, keywords ----------------------------------------------------------------------------


@query(f"SELECT k, k % 3 = 0 AS valid FROM {_KEYS}")
def ismn_valid(spark, sf):
    """Right check digit, a wrong one, and a wrong prefix."""
    bare = F.concat(F.lit("9790"), F.lpad(_k().cast("string"), 8, "0"))
    total = sum((F.substring(bare, i, 1).cast("int") * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    digit = F.pmod(10 - total % 10, F.lit(10))
    value = _pick(
        _k(), F.concat(bare, digit), F.concat(bare, (digit + 1) % 10), F.concat(F.lit("9791"), F.substring(bare, 5, 8), digit)
    )
    dashed = F.concat(F.substring(value, 1, 3), F.lit("-"), F.substring(value, 4, 20))
    return _orders(spark, sf).select("k", I.valid_ismn(F.when(_k() % 2 == 0, dashed).otherwise(value)).alias("valid"))


@query(f"SELECT k, k % 5 IN (0, 4) AS valid FROM {_KEYS}")
def message_ids(spark, sf):
    value = _pick(_k(), _text(_k(), "@news.org"), _text("<", _k(), "@news.org"), _text(_k(), "@news.org>"), _text("news.org"), _text("a<", _k(), "@x"))
    return _orders(spark, sf).select("k", I.valid_message_id(value).alias("valid"))


_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_SEASONS = ["Winter", "Spring", "Summer", "Fall"]


@query(f"""SELECT k, CASE WHEN k % 2 = 0 THEN a < b AND (s = 0 OR a = 4 OR b = 4) ELSE x < y OR x = 3 AND y = 0 END AS valid
           FROM (SELECT k, k % 12 AS a, (k // 12) % 12 AS b, (k // 2) % 3 % 2 AS s, (k // 3) % 4 AS x, (k // 5) % 4 AS y FROM {_KEYS}) q""")
def month_ranges(spark, sf):
    """Months by name, the first one shortened in a third of the rows, or seasons."""
    names = F.array(*[F.lit(m) for m in _MONTHS])
    a, b = F.get(names, (_k() % 12).cast("int")), F.get(names, (F.floor(_k() / 12) % 12).cast("int"))
    short = F.floor(_k() / 2) % 3 % 2 == 1
    a = F.when(short & (a != "May"), F.substring(a, 1, 3)).otherwise(a)
    seasons = F.array(*[F.lit(m) for m in _SEASONS])
    x, y = F.get(seasons, (F.floor(_k() / 3) % 4).cast("int")), F.get(seasons, (F.floor(_k() / 5) % 4).cast("int"))
    start, end = F.when(_k() % 2 == 0, a).otherwise(x), F.when(_k() % 2 == 0, b).otherwise(y)
    rows = _orders(spark, sf).select("k", start.alias("start"), end.alias("end"))
    return rows.select("k", DT.valid_month_range("start", "end").alias("valid"))


@query(f"SELECT k, CASE WHEN k % 7 = 0 THEN FALSE ELSE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' END AS closed FROM {_KEYS}")
def embargo_days(spark, sf):
    day = F.when(_k() % 7 != 0, F.col("o_orderdate").cast("date"))
    return _orders(spark, sf).select("k", DT.embargoed(day, F.lit("1996-01-01").cast("date")).alias("closed"))


_PLANTED = [
    ("replacement", "�"), ("zero width joiner", "‍"), ("zero width space", "​"), ("hair space", " "),
    ("soft hyphen", "­"), ("horizontal tab", "\t"), ("carriage return", "\r"), ("delete", "\x7f"), ("C0 control", "\x02"),
    ("C1 control", "\x85"), ("Specials", "￹"), ("Private use area", ""), ("Supplementary Private Use Area-A", "\U000f0000"),
    ("Supplementary Private Use Area-B", "\U00100000"),
]
_GROUP_SQL = " UNION ALL ".join(
    f"SELECT k, '{g}' AS \"group\", CAST(3 AS BIGINT) AS position FROM {_KEYS} WHERE k % {len(_PLANTED)} = {i}"
    for i, (g, _) in enumerate(_PLANTED)
)


@query(f"""{_GROUP_SQL} UNION ALL SELECT k, 'Specials', CAST(3 AS BIGINT) FROM {_KEYS} WHERE k % {len(_PLANTED)} = 0 UNION ALL SELECT k, 'line feed', CAST(5 AS BIGINT) FROM {_KEYS} WHERE k % 3 = 0
           UNION ALL SELECT k, 'stripmarker', CAST(length({_N}) + CASE k % 3 WHEN 0 THEN 8 ELSE 6 END AS BIGINT) FROM {_KEYS} WHERE k % 5 = 0
           UNION ALL SELECT k, 'delete', CAST(length({_N}) + CASE k % 3 WHEN 0 THEN 8 ELSE 6 END AS BIGINT) FROM {_KEYS}
             WHERE k % 5 = 0 AND k % {len(_PLANTED)} <> 7""")
def invisible_groups(spark, sf):
    """Every group of invisible characters, with the first place of each in texts that hold up to four of them."""
    mark = "\x7fUNIQ--ref-00000001-QINU\x7f"
    value = F.concat(
        F.lit("ab"), _pick(_k(), *[c for _, c in _PLANTED]), F.lit("c"), F.when(_k() % 3 == 0, "\nd").otherwise(""), _k().cast("string"),
        F.lit("e"), F.when(_k() % 5 == 0, mark).otherwise(""),
    )
    rows = _orders(spark, sf).select("k", F.create_map(F.lit("title"), value).alias("params"))
    return Q.invisible_report(rows).select("k", "group", F.col("position").cast("bigint").alias("position"))


# --- rules of classes ----------------------------------------------------------------------------------------


@query(f"""SELECT k, CASE k % 4 WHEN 0 THEN 'P' || {_N} WHEN 1 THEN 'Q' || {_N} WHEN 2 THEN 'P' || {_N} END AS place,
             CASE k % 5 WHEN 0 THEN 'Edinburgh' WHEN 1 THEN 'Belfast' WHEN 2 THEN 'London' WHEN 3 THEN 'London' ELSE 'e' END AS city FROM {_KEYS}""")
def places(spark, sf):
    """Place of publication before place; cities of a gazette by letter or name."""
    place = C.place_rule(_pick(_k(), _text("P", _k()), None, "", None), _pick(_k(), "x", _text("Q", _k()), _text("P", _k()), None))
    city = C.gazette_city(_pick(_k(), "gazette", "gazette", "gazette", "gazette", "book"), _pick(_k(), "E", "belfast", "x", None, "e"))
    return _orders(spark, sf).select("k", place.alias("place"), city.alias("city"))


@query(f"""SELECT k, CASE WHEN k % 4 IN (0, 1) THEN {_N} END AS seriesno,
             CASE k % 4 WHEN 0 THEN 'Name ' || {_N} WHEN 1 THEN 'D' WHEN 2 THEN 'T' || {_N} END AS title,
             CASE k % 4 WHEN 2 THEN 'http://x.org' END AS url, CASE k % 4 WHEN 3 THEN 'Kept' END AS one FROM {_KEYS}""")
def positional_params(spark, sf):
    """Unnamed parameters of some classes by place or by the kind of their value; those of other classes stay."""
    params = _pick(
        _k(),
        F.create_map(F.lit("1"), _k().cast("string"), F.lit("2"), _text("Name ", _k())),
        F.create_map(F.lit("1"), _k().cast("string"), F.lit("desc"), F.lit("D")),
        F.create_map(F.lit("1"), _text("T", _k()), F.lit("2"), F.lit("http://x.org")),
        F.create_map(F.lit("1"), F.lit("Kept"), F.lit("x"), F.lit("y")),
    )
    cls = _pick(_k(), "gnis", "nhle", "sports-reference", "book")
    rows = _orders(spark, sf).select("k", cls.alias("cls"), params.alias("params"))
    named = rows.select("k", C.remap_positional("cls", "params", O.AS_OF_YEAR).alias("m"))
    get = lambda n: F.try_element_at("m", F.lit(n))
    return named.select("k", get("seriesno").alias("seriesno"), get("title").alias("title"), get("url").alias("url"), get("1").alias("one"))


@query(f"""SELECT k, CASE k % 4 WHEN 0 THEN 'C' || {_N} WHEN 1 THEN 'A' || {_N} WHEN 2 THEN 'A' || {_N} ELSE 'A' || {_N} END AS last,
             CASE k % 4 WHEN 3 THEN 'T ' || {_N} || ' Слово' ELSE 'T ' || {_N} END AS title FROM {_KEYS}""")
def contributors(spark, sf):
    """A contribution to a book is by its contributor, not by the author of the book; titles in a foreign script follow."""
    more = _pick(
        _k(), _text("|contributor-last=C", _k(), "|contribution=Foreword"), "|contributor-last=C", "|journal=J|contributor-last=C|contribution=Foreword",
        "|script-title=ru:Слово",
    )
    text = F.concat(F.lit("{{cite book|title=T "), _k().cast("string"), F.lit("|last=A"), _k().cast("string"), F.lit("|first=B"), more, F.lit("}}"))
    rows = O.normalize_citations(_orders(spark, sf).select("k", text.alias("citation")), fields=["Title", "Authors"])
    return rows.select("k", F.get("Authors", F.lit(0))["last"].alias("last"), F.col("Title").alias("title"))


@query(f'SELECT page_id, type_of_citation, "Title", "URL", "Authors" FROM ({_NORMAL}) n')
def minimal_fields(spark, sf):
    """The columns that labelling reads, from a normaliser that plans no others."""
    found = normalized_cites(spark, sf, O.MINIMAL_FIELDS)
    rows = O.minimal(O.legacy_text(found).withColumn("page_title", F.col("page_id")))
    return rows.select(F.col("page_title").alias("page_id"), "type_of_citation", "Title", "URL", "Authors")


# Citations that show one rare kind each, with the kinds that they must have among _RARE.
_RARE = ["maint_untitled", "maint_embargo", "maint_disp_auth_ed", "maint_extra_text_edition", "bad_date", "invalid_param_val", "bad_ismn",
         "bad_message_id", "maint_asin_isbn", "contributor_ignored", "missing_name", "trans_missing_title", "arxiv_missing", "bad_lccn"]
_SHOWN = [
    ("journal|title=none|journal=J", "maint_untitled"), ("journal|title=none|magazine=J", ""), ("book|title=none", ""),
    ("journal|title=T|pmc=12|embargo=2001-05-06", "maint_embargo"), ("journal|title=T|pmc=12|embargo=2040-05-06", ""),
    ("journal|title=T|pmc=12|embargo=someday", "bad_date"), ("book|title=T|last1=A|last2=B|display-authors=2", "maint_disp_auth_ed"),
    ("book|title=T|last1=A|last2=B|display-authors=1", ""), ("book|title=T|vauthors=A B, C D|display-authors=3", "maint_disp_auth_ed"),
    ("book|title=T|last1=A|last2=B|display-authors=et al.", ""), ("book|title=T|last1=A|display-authors=few", "invalid_param_val"),
    ("book|title=T|editor=E|display-editors=few", "invalid_param_val"), ("book|title=T|edition=2nd ed.", "maint_extra_text_edition"),
    ("book|title=T|edition=Revised edition", "maint_extra_text_edition"), ("book|title=T|edition=2nd", ""), ("book|title=T|edition=Limited", ""),
    ("book|title=T|doi-broken-date=2001-13-01", "bad_date"), ("book|title=T|date=5 May 2001|year=2001", ""),
    ("book|title=T|date=5 May 2001|year=c. 2001", ""), ("book|title=T|date=5 May 2001|year=x2001", "bad_date"),
    ("book|title=T|year=2001|publication-date=2001-99-01", "bad_date"), ("book|title=T|publication-date=May 2001", ""),
    ("book|title=T|ismn=979-0-2306-7118-6", "bad_ismn"), ("newsgroup|title=T|message-id=abc", "bad_message_id"),
    ("book|title=T|asin=0306406152", "maint_asin_isbn"), ("web|title=T|url=http://x.org|contributor=C", "contributor_ignored"),
    ("book|title=T|last1=A|last3=C", "missing_name"), ("book|trans-title=T", "trans_missing_title"), ("arxiv|title=T", "arxiv_missing"),
    ("book|title=T|lccn=x-1", "bad_lccn"),
]
_SHOWN_SQL = " ".join(f"WHEN {i} THEN '{kinds}'" for i, (_, kinds) in enumerate(_SHOWN))


@query(f"SELECT k, CASE k % {len(_SHOWN)} {_SHOWN_SQL} END AS kinds FROM {_KEYS}")
def rare_error_kinds(spark, sf):
    """Kinds of the quality report that hardly a citation has: dates of all parameters, names to show, editions, untitled articles."""
    text = F.concat(F.lit("{{cite "), _pick(_k(), *[t for t, _ in _SHOWN]), F.lit("|page="), _k().cast("string"), F.lit("}}"))
    found = Q.with_errors(O.parse_templates(_orders(spark, sf).select("k", text.alias("citation")), "citation"))
    rare = F.array_sort(F.array_intersect("errors", F.array(*[F.lit(x) for x in _RARE])))
    return found.select("k", F.array_join(rare, ",").alias("kinds"))


# --- sources -------------------------------------------------------------------------------------------------


@query(f"""SELECT k AS page_id, 'T' || {_N} AS page_title, 'body & <b> ' || {_N} || chr(10) || 'line' AS content,
             '-articles' || CAST(k % 3 AS VARCHAR) || '.xml-p1p9' AS part FROM {_KEYS} WHERE k % 4 NOT IN (1, 2)""")
def dump_articles(spark, sf):
    """Pages written as XML and read as a dump: other name spaces and redirects are no articles."""
    page = F.concat(
        F.lit("<page><title>T"), _k().cast("string"), F.lit("</title><ns>"), (_k() % 4 == 1).cast("int").cast("string"), F.lit("</ns><id>"),
        _k().cast("string"), F.lit("</id>"), F.when(_k() % 4 == 2, '<redirect title="Z" />').otherwise(""),
        F.lit("<revision><id>1</id><parentid>0</parentid><text bytes=\"3\">body &amp; &lt;b&gt; "), _k().cast("string"),
        F.lit("\nline</text></revision></page>"),
    )
    path = scratch_path(spark, "dump")
    _orders(spark, sf).select(page.alias("value")).write.text(path)
    found = dump.page_content(dump.read_dump(spark, path))
    part = F.concat(F.lit("hdfs://x/enwiki-articles"), (F.col("page_id") % 3).cast("string"), F.lit(".xml-p1p9.bz2"))
    return dump.with_dump_part(found.withColumn("file", part)).select("page_id", "page_title", "content", "part")


@query(f"SELECT k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM {_KEYS}")
def batches_written(spark, sf):
    """A stage written in batches, all of them done in the first run and none in the second."""
    rows = _orders(spark, sf).select("k", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    path = scratch_path(spark, "batches")
    first = dump.write_partitioned_batches(rows, path, "k", batches=8, jobs=2)
    again = dump.write_partitioned_batches(rows.where("false"), path, "k", batches=8)
    return dump.read_stage(spark, path).where(F.lit(first == 8 and again == 0)).select("k", "day")


@query(f"""SELECT k, 'a "quoted", text' || chr(10) || 'line ' || {_N} AS citations, CAST(2 AS BIGINT) AS n, 'S' || {_N} AS first FROM {_KEYS}""")
def csv_round_trip(spark, sf):
    rows = _orders(spark, sf).select("k", _text('a "quoted", text\nline ', _k()).alias("citations"), _text("['S", _k(), "', 'T']").alias("sections"))
    path = scratch_path(spark, "csv")
    lists.write_csv(rows, path)
    back = lists.csv_array_columns(lists.read_csv(spark, path, "k long, citations string, sections string"), "sections")
    return back.select("k", "citations", F.size("sections").cast("bigint").alias("n"), F.get("sections", F.lit(0)).alias("first"))


@query("SELECT p_brand AS template, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand")
def template_count_file(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_brand").alias("template")).count()
    path = scratch_path(spark, "counts")
    lists.write_csv(part, path)
    return lists.template_counts(spark, path).select("template", F.col("count").alias("n"))


@query("""SELECT 'https://list' || CAST(s_suppkey AS VARCHAR) || '.org' AS source, 'https://site' || CAST(s_suppkey AS VARCHAR) || '.com/' || x AS address
          FROM supplier, (SELECT unnest(['a', 'b']) AS x) y""")
def media_links(spark, sf):
    """Addresses with the page that they were found on."""
    s = F.col("s_suppkey").cast("string")
    block = F.concat(F.lit("***https://list"), s, F.lit('.org\n"https://site'), s, F.lit('.com/a"\n\n"https://site'), s, F.lit('.com/b"'))
    path = scratch_path(spark, "links")
    spark.read.parquet(f"{sf}/supplier.parquet").select(block.alias("value")).write.text(path)
    return lists.media_links_by_source(spark, path).select("source", "address")


@query("""SELECT 'https://site' || CAST(s_suppkey AS VARCHAR) || '.com' AS address, 'link' AS list FROM supplier
          UNION ALL SELECT 'site' || CAST(s_suppkey AS VARCHAR) || '.com', 'csv' FROM supplier WHERE s_suppkey % 2 = 0
          UNION ALL SELECT 'www.site' || CAST(s_suppkey AS VARCHAR) || '.co.uk', 'bias' FROM supplier""")
def domain_lists(spark, sf):
    """The three kinds of lists, each written as its file and read."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    files = {
        "csv": F.when(_k() % 2 == 0, _text("site", _k(), ".com,1")).otherwise(_text("nodot,", _k())),
        "bias": _text("The Paper ", _k(), " (www.site", _k(), ".co.uk)"),
        "link": F.when(_k() < 0, "").otherwise(_text("***https://src.org\nhttps://site", _k(), ".com")),
    }
    read = {"csv": lists.read_domain_csv, "bias": lists.read_bias_list, "link": lists.read_media_links}
    out = None
    for name, value in files.items():
        path = scratch_path(spark, name)
        rows.select(value.alias("value")).write.text(path)
        found = read[name](spark, path).select("address", F.lit(name).alias("list"))
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT 'site' || CAST(s_suppkey AS VARCHAR) AS domain FROM supplier")
def domains_from_text(spark, sf):
    """A set of domains as one text in a file, and back."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("site"), "s_suppkey").alias("domain"))
    path = scratch_path(spark, "domains")
    lists.domains_text(rows).select(F.col("domains").alias("value")).write.text(path)
    return lists.read_domains_text(spark, path)
