"""URL rules, and redirect equivalence that carries their decisions to aliases.

Rules are ``(verdict, host + path)``. A rule fits its host and all subdomains where the url's
path starts with the rule's path; the longest fitting rule decides (of equal length: allow).

Pages that no rule fits take the decision of their alias group. Groups are the connected
components of redirect and canonical-link edges: canonical links and meta refreshes in the html, and a redirect
log where there is one. Sites redirect a url to its canonical form (https, without tracking parameters), so a link to
one form of a url meets all its others. One explicitly allowed member makes the group allowed; else one blocked member makes it
blocked; else, and for pages with no alias, the verdict is allow.

With ``every_form``, as in the query, each url has an edge to its form, so that forms of one url are a group whether a link
meets them or not. Without it an edge's ends are forms, and urls that no link meets have no group.

Urls are nodes without their fragment, with scheme and host in lower case.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
has no alias; null or empty html has no link, html of any length is read whole; repeated rows are judged row by
row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stage, table
from tessera.llm.components import connected_components

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a node: no fragment, scheme and host in lower case."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    site = F.regexp_extract(plain, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(ascii_lower(site), F.substring(plain, F.length(site) + 1, F.length(plain)))


def canonical_form(node: Column) -> Column:
    """The node with https, and without ``utm_`` parameters."""
    kept = F.regexp_replace(F.regexp_replace(node, "([?&])utm_[^&]*", "$1"), "&+", "&")
    kept = F.regexp_replace(F.replace(kept, F.lit("?&"), F.lit("?")), "[?&]$", "")
    return F.regexp_replace(F.when(node.contains("utm_"), kept).otherwise(node), "^http://", "https://")


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    The list is a literal in the plan, meant for up to about a thousand rules.
    """
    made = []
    for verdict, text in rules:
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        made.append(
            F.when(
                fits,
                F.struct(
                    F.lit(len(text)).alias("length"), F.lit(int(verdict == "allow")).alias("allow"),
                    F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"),
                ),
            )
        )
    return F.array_max(F.array(*made))


def _absolute(base: Column, link: Column) -> Column:
    """The link as an absolute url without fragment: absolute, //host, /path and relative forms."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(folder.endswith("/"), F.concat(folder, link))
        .otherwise(F.concat(site, F.lit("/"), link))
    )
    return F.regexp_replace(full, r"(?s)#.*$", "")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(a, b)``: each page's node, and the targets of its canonical links and meta refreshes."""
    text = F.col(html)

    def targets(word: str, tag: str, attribute: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(tag), 0), lambda t: F.regexp_extract(t, attribute, 1))
        return F.when(F.lower(text).contains(word), found).otherwise(F.array().cast("array<string>"))

    here = pages.where(F.col(url).contains("://")).select(node_of(F.col(url)).alias("a"), F.concat(targets("canonical", _CANONICAL, _HREF), targets("http-equiv", _REFRESH, _REFRESH_URL)).alias("links"))
    return here.select("a", F.explode("links").alias("link")).where("link != ''").select("a", node_of(_absolute(F.col("a"), F.col("link"))).alias("b"))


def judge_urls(
    pages: DataFrame, rules=RULES, redirects: DataFrame | None = None,
    key: str = "page_id", url: str = "url", html: str = "html", every_form: bool = False,
) -> DataFrame:
    """``(key, host, path, rule, verdict, alias_group)`` for each page.

    ``redirects`` adds ``(a, b)`` url pairs, such as a crawler's redirect log, to the links in html.
    """
    edges, node = alias_edges(pages, url, html), node_of(F.col(url))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(*(node_of(F.col(c)).alias(c) for c in ("a", "b"))))
    if every_form:
        pairs = [("a", F.col("b")), ("a", canonical_form(F.col("a"))), ("b", canonical_form(F.col("b")))]
        edges = edges.select(F.inline(F.array(*(F.struct(F.col(x).alias("a"), y.alias("b")) for x, y in pairs))))
        edges = edges.unionByName(pages.where(F.col(url).contains("://")).select(node.alias("a"), canonical_form(node).alias("b")))
    else:
        edges, node = edges.select(*(canonical_form(F.col(c)).alias(c) for c in ("a", "b"))), canonical_form(node)
    edges = edges.where("a != b")
    members = connected_components(edges)
    own = rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    groups = stage(
        members.withColumn("own", own).groupBy("component").agg(
            F.when(F.max(F.col("own") == "allow"), "allow").when(F.max(F.col("own") == "block"), "block").alias("group_verdict")
        ),
        "url-groups",
    )
    alias = stage(members.join(groups, "component").select("node", "component", "group_verdict"), "url-alias")
    found = pages.select(
        F.col(key), node.alias("node"),
        host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
    ).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    return found.join(alias, "node", "left").select(
        key, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "group_verdict", F.lit("allow")).alias("verdict"),
        F.col("component").alias("alias_group"),
    )


def op1_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), every_form=True)


_SQL_RULES = """(VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'),
  ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')) AS r(verdict, rhost, rpath, rule)"""


def _fit(source: str, keys: str) -> str:
    return f"""SELECT {keys}, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM {source} s JOIN {_SQL_RULES}
    ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath) GROUP BY ALL"""


_SQL_PARTS = r"""coalesce(translate(regexp_extract({u}, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract({u}, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path"""

def _node_sql(u: str) -> str:
    plain = f"regexp_replace({u}, '#.*$', '', 's')"
    site = f"regexp_extract({plain}, '^(.*?://[^/?#]*)', 1, 's')"
    return f"translate({site}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr({plain}, length({site}) + 1)"


_FORM_SQL = """regexp_replace(CASE WHEN contains(node, 'utm_') THEN regexp_replace(replace(regexp_replace(regexp_replace(node, '([?&])utm_[^&]*', '\\1', 'g'), '&+', '&', 'g'), '?&', '?'), '[?&]$', '') ELSE node END, '^http://', 'https://')"""


def _sql(every_form: bool) -> str:
    return rf"""
WITH RECURSIVE p AS (SELECT *, {_FORM_SQL} AS form FROM (SELECT page_id, {_node_sql('url')} AS node, html, {_SQL_PARTS.format(u='url')} FROM pages)),
tags AS (
  SELECT node AS a, unnest(list_concat(
    list_transform(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), lambda t: regexp_extract(t, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is')),
    list_transform(regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), lambda t: regexp_extract(t, '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is')))) AS link
  FROM p WHERE node LIKE '%://%' AND html IS NOT NULL),
links AS (
  SELECT a, regexp_replace(CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(a, '^(.*?)://', 1, 's') || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(a, '^(.*?://[^/?#]*)', 1, 's') || link
    WHEN ends_with(regexp_extract(a, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1, 's'), '/') THEN regexp_extract(a, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1, 's') || link
    ELSE regexp_extract(a, '^(.*?://[^/?#]*)', 1, 's') || '/' || link END, '#.*$', '', 's') AS b
  FROM tags WHERE link != ''),
ends AS (SELECT a, {_node_sql('b')} AS b FROM links),
{f"edges AS (SELECT * FROM ends UNION SELECT node, {_FORM_SQL} FROM (SELECT node FROM p WHERE node LIKE '%://%' UNION SELECT b FROM ends))," if every_form else f"edges AS (SELECT {_FORM_SQL.replace('node', 'a')} AS a, {_FORM_SQL.replace('node', 'b')} AS b FROM ends),"}
sym AS (SELECT a, b FROM edges WHERE a != b UNION SELECT b, a FROM edges WHERE a != b),
reach AS (SELECT a AS node, a AS other FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON r.other = s.a),
alias AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
nodes AS (SELECT node, component, {_SQL_PARTS.format(u='node')} FROM alias),
node_fit AS ({_fit('nodes', 's.node')}),
groups AS (
  SELECT n.component, CASE WHEN bool_or(f.verdict = 'allow') THEN 'allow' WHEN bool_or(f.verdict = 'block') THEN 'block' END AS group_verdict
  FROM nodes n LEFT JOIN node_fit f USING (node) GROUP BY 1),
fit AS ({_fit('(SELECT DISTINCT host, path FROM p)', 's.host, s.path')})
SELECT p.page_id, p.host, p.path, fit.rule AS rule, coalesce(fit.verdict, g.group_verdict, 'allow') AS verdict, a.component AS alias_group
FROM p LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path LEFT JOIN alias a ON a.node = p.{'node' if every_form else 'form'} LEFT JOIN groups g ON g.component = a.component
"""


ORACLE_SQL = _sql(every_form=False)  # of judge_urls as it is called without more
QUERY_SQL = _sql(every_form=True)
