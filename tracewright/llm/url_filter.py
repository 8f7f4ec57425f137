"""URL block and allow rules that reach redirect and canonical aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.spread import hot_from, join_each
from ..plans.storage import stored
from .columns import named

#: (verdict, host, path prefix). A rule is written host + path.
Rule = tuple[str, str, str]

HOST = r"^[\s\S]*?://([^/?#]*)"
PATH = r"^[\s\S]*?://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
CANONICAL = r"""(?i)<link\s[^>]*rel\s*=\s*["']?canonical["']?[^>]*>"""
REFRESH = r"""(?i)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>"""
HREF = r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?i)url\s*=\s*["']?([^"'\s>;]+)"""
BASE = r"""(?i)<base\s[^>]*>"""
#: What html writes for these characters; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x26;", "&"), ("&#38;", "&"), ("&amp;", "&"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(_part(url, HOST), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return _part(url, PATH)


def resolved_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    step = F.aggregate(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), F.lit(""), lambda a, x: F.when(x == ".", a).when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), x)))
    return F.when(path.contains("/."), step).otherwise(path)


def normal_form(url: Column) -> Column:
    """One text for forms that sites answer alike: no scheme, ``www.``, fragment, dot segments, closing slashes or ``utm_`` query."""
    query = F.regexp_replace(_part(url, QUERY), r"^utm_[^&]*(&utm_[^&]*)*$", "")
    asked = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    return F.concat(F.regexp_replace(url_host(url), r"^www\.", ""), F.regexp_replace(resolved_path(url_path(url)), "/+$", ""), asked)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _decoded(text: Column) -> Column:
    for written, meant in ENTITIES:
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src_url, dst_url``: all canonical links and refresh redirects of each page.

    Relative ones are taken against the page's ``base``, if that is absolute, or
    its url. Null urls and html, and urls without ``://``, give none.
    """
    html, src = named(html_col).cast("string"), named(url_col).cast("string")
    base = _decoded(F.regexp_extract(F.regexp_extract(html, BASE, 0), HREF, 1))
    found = F.concat(F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), 0), lambda tag: F.regexp_extract(tag, HREF, 1)), F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 0), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1)))
    links = pages.where(src.contains("://") & html.isNotNull()).select(src.alias("src_url"), F.when(base.contains("://"), base).otherwise(src).alias("from"), F.explode(F.array_distinct(found)).alias("to"))
    links = links.withColumn("to", _decoded(F.col("to"))).where("to <> ''")
    root = F.regexp_extract("from", r"^([\s\S]*?://[^/?#]*)", 1)
    target = F.when(F.col("to").contains("://"), F.col("to"))
    target = target.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to")))
    target = target.when(F.col("to").startswith("/"), F.concat(root, F.col("to")))
    folder = F.regexp_extract("from", r"^([\s\S]*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    slash = F.when(folder.endswith("/"), "").otherwise("/")
    return links.select("src_url", target.otherwise(F.concat(folder, slash, F.col("to"))).alias("dst_url"))


def judge_urls(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``id_col, host, path, rule, verdict, component`` for every page.

    The longest rule that fits a url gives its verdict. Any other url takes part
    in its aliases' verdict: urls of one normal form, and those that redirects
    and canonical links (of the html, and ``links`` with src_url and dst_url)
    connect, form a component; a member with an allow rule makes it allowed, else
    one with a block rule blocked, targets that are not pages included. Without
    either the verdict is allow. A page counts with all of its links. Null urls, and urls without ``://``, have empty
    host and path, no alias and no rule; repeated pages are judged each; extra
    columns are ignored; no pages, no result. ``rules`` is a parameter of bounded
    length (it is part of the plan).
    """
    url = named(url_col).cast("string")
    judged = pages.select(named(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"), F.when(url.contains("://"), normal_form(url)).alias("form"))
    judged = stored(judged.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)), "judged")
    forms = judged.where("form is not null").groupBy("form").agg(F.min("found.verdict").alias("verdict"), F.count(F.lit(1)).alias("n"))  # allow sorts before block
    forms = stored(forms, "forms")
    edges = links.select("src_url", "dst_url") if links is not None else None
    if html_col is not None:
        own = page_links(pages, url_col, html_col)
        edges = own if edges is None else edges.unionAll(own)
    member = forms.select("form", "verdict")
    if edges is not None:
        edges = edges.where(F.col("src_url").contains("://") & F.col("dst_url").contains("://"))
        dst = F.col("dst_url")
        edges = stored(edges.select(normal_form(F.col("src_url")).alias("src"), normal_form(dst).alias("dst"), matching_rule(url_host(dst), url_path(dst), rules)["verdict"].alias("verdict")).distinct(), "links")
        member = member.unionAll(edges.groupBy(F.col("dst").alias("form")).agg(F.min("verdict").alias("verdict")))
        found = stored(connected_components(edges), "aliases")
        component = F.coalesce("component", "form").alias("component")
        member = member.join(found, F.col("form") == F.col("node"), "left").select(component, "verdict")
        forms = forms.join(found, F.col("form") == F.col("node"), "left").select("form", "n", component)
    else:
        member, forms = member.withColumnRenamed("form", "component"), forms.select("form", "n", F.col("form").alias("component"))
    ruled = member.where("component is not null").groupBy("component").agg(F.min("verdict").alias("shared"), F.count(F.lit(1)).alias("rows"))
    most = hot_from(judged.count())
    forms = join_each(forms, ruled, ["component"], F.col("form"), most, "rows")  # a component's forms are spread if they are many
    joined = join_each(judged, forms, ["form"], F.struct("id", "form"), most, how="left")  # and the pages of one form
    return joined.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), "shared", F.lit("allow")).alias("verdict"), "component")


def judge_oracle(rules: list[Rule]) -> str:
    """The same verdicts in DuckDB, with the links' closure by recursion."""

    def case(host: str, path: str, what: int) -> str:
        whens = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(v, h + p)[what]}'" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
        return f"CASE {whens} END"

    def host(url: str) -> str:
        return f"translate(COALESCE(regexp_extract({url}, '{HOST}', 1), ''), '{UPPER}', '{LOWER}')"

    def path(url: str) -> str:
        return f"COALESCE(regexp_extract({url}, '{PATH}', 1), '')"

    def form(url: str) -> str:
        query = f"regexp_replace(COALESCE(regexp_extract({url}, '{QUERY}', 1), ''), '^utm_[^&]*(&utm_[^&]*)*$', '')"
        segments = f"string_split({path(url)}, '/')[2:]"
        clean = f"CASE WHEN contains({path(url)}, '/.') THEN list_reduce({segments}, lambda a, x: CASE WHEN x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END, '') ELSE {path(url)} END"
        return f"regexp_replace({host(url)}, '^www\\.', '') || regexp_replace({clean}, '/+$', '') || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"

    def decoded(text: str) -> str:
        for written, meant in ENTITIES:
            text = f"replace({text}, '{written}', '{meant.replace(chr(39), chr(39) * 2)}')"
        return text

    q = {k: v.replace("'", "''") for k, v in {"C": CANONICAL, "R": REFRESH, "H": HREF, "U": REFRESH_URL, "B": BASE}.items()}
    base = decoded(f"regexp_extract(regexp_extract(html, '{q['B']}'), '{q['H']}', 1)")
    return f"""
WITH RECURSIVE j AS (
  SELECT page_id, {host("url")} AS host, {path("url")} AS path, CASE WHEN contains(url, '://') THEN {form("url")} END AS form FROM pages),
p AS (SELECT *, {case("host", "path", 0)} AS own, {case("host", "path", 1)} AS rule FROM j),
l AS (
  SELECT url, CASE WHEN contains({base}, '://') THEN {base} ELSE url END AS base,
         unnest(list_concat(list_transform(regexp_extract_all(html, '{q["C"]}'), lambda t: regexp_extract(t, '{q["H"]}', 1)), list_transform(regexp_extract_all(html, '{q["R"]}'), lambda t: regexp_extract(t, '{q["U"]}', 1)))) AS target
  FROM pages WHERE contains(url, '://') AND html IS NOT NULL),
t AS (SELECT url, base, {decoded("target")} AS target FROM l),
a AS (
  SELECT url, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN regexp_extract(base, '^([\\s\\S]*?://[^/?#]*)', 1) || target
    ELSE rtrim(regexp_extract(base, '^([\\s\\S]*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || target END AS target
  FROM t WHERE target <> ''),
e AS (SELECT DISTINCT {form("url")} AS src, {form("target")} AS dst, {case(host("target"), path("target"), 0)} AS verdict FROM a WHERE contains(target, '://')),
b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
r AS (SELECT x, x AS y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
c AS (SELECT x AS form, min(y) AS component FROM r GROUP BY x),
m AS (SELECT form, own AS verdict FROM p WHERE own IS NOT NULL UNION ALL SELECT dst, verdict FROM e WHERE verdict IS NOT NULL),
s AS (SELECT COALESCE(c.component, m.form) AS component, min(m.verdict) AS shared FROM m LEFT JOIN c USING (form) WHERE m.form IS NOT NULL GROUP BY 1)
SELECT p.page_id, p.host, p.path, p.rule, COALESCE(p.own, s.shared, 'allow') AS verdict
FROM p LEFT JOIN c USING (form) LEFT JOIN s ON s.component = COALESCE(c.component, p.form)"""
