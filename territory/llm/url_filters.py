"""Op 1. URL filters with redirect equivalence, in DataFrame operations only.

Rules fit a host with all its subdomains and a path prefix; the longest rule that fits decides. Urls without a rule take
part in redirect equivalence: every page's canonical link and refresh redirect is an edge between two urls (fragments are
cut, they never reach a server), and distributed connected components make classes of aliases. A url without a rule of
its own is blocked if its class holds a url that a rule blocks and none that a rule allows: an explicit allow takes
precedence over blocks that would only be passed on, and a url's own rule over both. Targets that are no page of the
table carry decisions too.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, has no alias and is allowed.
Null or empty html has no edges. Repeated rows are judged one by one. Other columns are not read. Nothing is dropped or
capped: hub urls are handled by the component rounds, and repeated page urls only meet a table of distinct urls.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.common import cut, let
from territory.llm.components import connected_components


class UrlRule(NamedTuple):
    """``rule`` is a host, then a path that starts with ``/``; ``action`` is allow or block."""

    action: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (UrlRule("block", "net/"), UrlRule("allow", "example.net/en/"), UrlRule("block", "example.com/de/"), UrlRule("allow", "org/fr/"))

_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'>\s]+)"""
_REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_BASE = r"(?is)<base\b[^>]*>"
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_PORT = "^(http://.*):80$|^(https://.*):443$|:$"
_REFERENCE = "(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"
#: Character references by name that a url in an attribute may need; the ampersand's own comes last.
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
_TARGET = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*\burl\s*=\s*["']?\s*([^"'>\s]+)"""


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _group(value: str, pattern: str, g: int) -> str:
    return f"regexp_extract({value}, {_text(pattern)}, {g})"


def _like(value: str, pattern: str) -> str:
    return f"{value} RLIKE {_text(pattern)}"


def _link(tag: str) -> str:
    """The target of a canonical link or a refresh, else null."""
    return f"CASE WHEN {_like(tag, _CANONICAL)} THEN {_group(tag, _HREF, 1)} WHEN {_like(tag, _REFRESH)} THEN {_group(tag, _TARGET, 1)} END"


def _lower(value: str) -> str:
    return f"translate({value}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _rest(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _host(url: str) -> str:
    return f"coalesce({_lower(_group(_rest(url), '^[^/?#]*', 0))}, '')"


def _path(url: str) -> str:
    return f"coalesce({_group(_rest(url), '^[^/?#]*([^?#]*)', 1)}, '')"


_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def _no_dots(path: str) -> str:
    """A path without its dot segments; it begins with a slash."""
    step = "if(s = '..', slice(kept, 1, greatest(size(kept) - 1, 0)), if(s = '.', kept, concat(kept, array(s))))"
    kept = f"aggregate(slice(split({path}, '/'), 2, length({path})), cast(array() as array<string>), (kept, s) -> {step})"
    ends = f"{_like(path, '/[.]{1,2}$')}"
    return f"CASE WHEN {path} LIKE '%/.%' THEN concat('/', {let('k', kept, f"concat(array_join(k, '/'), if({ends} AND size(k) > 0, '/', ''))")}) ELSE {path} END"


def _node(url: str) -> str:
    """The url with a lower-case scheme and host, without a default port, with a path without dot segments and no fragment; null
    without a scheme and ``://``."""
    head, path, query = _group("u", f"^{_SCHEME}://[^/?#]*", 0), _group("u", f"^{_SCHEME}://[^/?#]*([^?#]*)", 1), _group("u", f"^{_SCHEME}://[^/?#]*[^?#]*([^#]*)", 1)
    origin = f"regexp_replace({_lower(head)}, {_text(_PORT)}, '$1$2')"
    rooted = let("p", f"if({path} LIKE '/%', {path}, concat('/', {path}))", _no_dots("p"))
    return let("u", url, f"CASE WHEN {_like('u', f'^{_SCHEME}://')} THEN concat({origin}, {rooted}, {query}) END")


def _decoded(value: str) -> str:
    """A text with its numeric references, and the named ones of ``_NAMED``, decoded; numbers that are no character stay."""
    number = "if(substr(m, 3, 1) IN ('x', 'X'), cast(conv(substr(m, 4, length(m) - 4), 16, 10) as int), cast(substr(m, 3, length(m) - 3) as int))"
    letter = let("c", number, "if(c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111, decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32'), m)")
    out = f"aggregate(array_distinct(regexp_extract_all({value}, {_text(_REFERENCE)}, 0)), {value}, (t, m) -> replace(t, m, {letter}))"
    for name, char in _NAMED:
        out = f"replace({out}, '{name}', {_text(char)})"
    return f"CASE WHEN instr({value}, '&') > 0 THEN {out} ELSE {value} END"


def _absolute(base: str, target: str) -> str:
    """The target of a link, seen from a base url that is a node."""
    root, path = _group(base, f"^{_SCHEME}://[^/]*", 0), _group(base, f"^{_SCHEME}://[^/]*([^?]*)", 1)
    return (
        f"CASE WHEN {target} = '' OR {target} LIKE '#%' THEN NULL WHEN {_like(target, f'^{_SCHEME}://')} THEN {target} "
        f"WHEN {target} LIKE '//%' THEN concat({_group(base, f'^{_SCHEME}:', 0)}, {target}) WHEN {target} LIKE '/%' THEN concat({root}, {target}) "
        f"WHEN {target} LIKE '?%' THEN concat({root}, {path}, {target}) ELSE concat({root}, {_group(path, '^.*/', 0)}, {target}) END"
    )


def _rule(host: str, path: str, rules) -> str:
    """SQL of the longest rule that fits, or null; for rules of one length, the first by name."""
    when = "".join(
        f" WHEN ({host} = '{r.host}' OR {host} LIKE '%.{r.host}') AND {path} LIKE '{r.path}%' THEN '{r.rule}'" for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    )
    return f"CASE{when} END"


def _action(rule: str, rules) -> str:
    return "CASE " + rule + "".join(f" WHEN '{r.rule}' THEN '{r.action}'" for r in rules) + " END"


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): pairs of different urls that a canonical link or a refresh redirect joins."""
    page = f"CASE WHEN instr(`{html}`, '<!--') > 0 THEN regexp_replace(`{html}`, {_text(_COMMENT)}, '') ELSE `{html}` END"
    plain = pages.selectExpr(f"{_node(f'`{url}`')} as a", f"{page} as h").where("a is not null and h is not null")
    tags = f"filter(transform(regexp_extract_all(h, {_text(_TAG)}, 0), g -> {let('l', _link('g'), _decoded('l'))}), x -> x <> '')"
    first = f"get(filter(transform(regexp_extract_all(h, {_text(_BASE)}, 0), g -> {let('l', _group('g', _HREF, 1), _decoded('l'))}), x -> x <> ''), 0)"
    found = plain.selectExpr("a", f"{tags} as targets", f"{first} as base").where("size(targets) > 0")
    based = found.selectExpr("a", "targets", f"CASE WHEN base IS NULL THEN a ELSE coalesce({_node(_absolute('a', 'base'))}, a) END as base")
    return based.selectExpr("a", "base", "explode(targets) as target").selectExpr("a", f"{_node(_absolute('base', 'target'))} as b").where("a <> b").distinct()


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, url, host, path, rule, alias_of, verdict) of every row."""
    if any(set("'%_\\") & set(r.rule) for r in rules):
        raise ValueError("a rule holds a character that this compiler does not take")
    aliases = connected_components(cut(edges(pages, url, html)))
    parts = aliases.selectExpr("node", "component", f"{_host('node')} as host", f"{_path('node')} as path")
    acts = parts.selectExpr("node", "component", f"{_rule('host', 'path', rules)} as rule").selectExpr("node", "component", f"{_action('rule', rules)} as action")
    classes = acts.groupBy("component").agg(F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("blocked"), F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("allowed"))
    told = acts.join(classes, "component").selectExpr("node", "component as alias_of", "blocked and not allowed as passes_block")
    parsed = pages.selectExpr(f"`{id_col}`", f"`{url}` as url", f"{_host(f'`{url}`')} as host", f"{_path(f'`{url}`')} as path")
    ruled = parsed.selectExpr("*", f"{_rule('host', 'path', rules)} as rule", f"{_node('url')} as __node")
    joined = ruled.join(told, ruled["__node"] == told["node"], "left")
    verdict = f"coalesce({_action('rule', rules)}, CASE WHEN passes_block THEN 'block' ELSE 'allow' END)"
    return joined.selectExpr(f"`{id_col}`", "url", "host", "path", "rule", "alias_of", f"{verdict} as verdict")


def oracle_sql(rules=RULES) -> str:
    """DuckDB SQL of the query's rows, written apart from the expressions above: urls are cut with string functions, rules
    are a table, classes come from a recursive walk."""
    listed = ", ".join(f"('{r.rule}', '{r.host}', '{r.path}', '{r.action}')" for r in rules)
    value = """("[^"]*"|'[^']*'|[^\\s>"']+)""".replace("'", "''")
    return rf"""
WITH RECURSIVE rules(rule, rule_host, rule_path, action) AS (VALUES {listed}),
plain AS (SELECT url, regexp_replace(html, '(?s)<!--.*?(-->|$)', '', 'g') AS html FROM pages),
links AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM plain),
metas AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) AS tag FROM plain),
canonical AS (SELECT url, regexp_extract(tag, '(?i)\bhref\s*=\s*{value}', 1) AS t FROM links WHERE regexp_matches(regexp_extract(tag, '(?i)\brel\s*=\s*{value}', 1), '(?i)\bcanonical\b')),
refreshed AS (SELECT url, regexp_extract(regexp_extract(tag, '(?i)\bcontent\s*=\s*{value}', 1), '(?i)\burl\s*=\s*([^\s"''>]+)', 1) AS t FROM metas WHERE regexp_matches(regexp_extract(tag, '(?i)\bhttp-equiv\s*=\s*{value}', 1), '(?i)refresh')),
found AS (SELECT url, trim(t, '"'' ') AS t FROM (SELECT * FROM canonical UNION ALL SELECT * FROM refreshed)),
bases AS (SELECT url, arg_min(trim(regexp_extract(tag, '(?i)\bhref\s*=\s*{value}', 1), '"'' '), i) AS t FROM (SELECT url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM (SELECT url, regexp_extract_all(html, '(?is)<base\b[^>]*>') AS tags FROM plain)) WHERE regexp_extract(tag, '(?i)\bhref\s*=\s*{value}', 1) <> '' GROUP BY url),
coded AS (SELECT DISTINCT t, unnest(regexp_extract_all(t, '(?i)&#(?:x[0-9a-f]{{1,6}}|[0-9]{{1,7}});')) AS m FROM (SELECT t FROM found UNION SELECT t FROM bases)),
numbers AS (SELECT t, m, CASE WHEN lower(m[3]) = 'x' THEN ('0x' || m[4:-2])::INTEGER ELSE (m[3:-2])::INTEGER END AS c FROM coded),
letters AS (SELECT t, list(m || chr(1) || chr(c)) AS pairs FROM numbers WHERE c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111 GROUP BY t),
numbered AS (SELECT t, list_reduce(list_prepend(t, pairs), lambda s, p: replace(s, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) AS d FROM letters),
decoded AS (SELECT t, replace(replace(replace(replace(replace(coalesce(d, t), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS d FROM (SELECT t FROM found UNION SELECT t FROM bases) LEFT JOIN numbered USING (t)),
own AS (SELECT DISTINCT url AS u, split_part(url, '#', 1) AS c FROM pages WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')),
own_cut AS (SELECT u, lower(split_part(c, '://', 1)) AS scheme, substr(c, strpos(c, '://') + 3) AS r FROM own),
own_parts AS (SELECT u, scheme, scheme || '://' || translate(split_part(split_part(r, '/', 1), '?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS origin, split_part(substr(r, length(split_part(split_part(r, '/', 1), '?', 1)) + 1), '?', 1) AS path FROM own_cut),
at_base AS (SELECT url AS u, d AS t FROM bases JOIN decoded USING (t) WHERE d <> ''),
base_whole AS (SELECT u, CASE WHEN starts_with(t, '#') THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN origin || t WHEN starts_with(t, '?') THEN origin || path || t
  ELSE origin || CASE WHEN path = '' THEN '/' ELSE '' END || substr(path, 1, length(path) - strpos(reverse(path), '/') + 1) || t END AS t FROM own_parts JOIN at_base USING (u)),
base_cut AS (SELECT u, lower(split_part(t, '://', 1)) AS scheme, substr(split_part(t, '#', 1), strpos(t, '://') + 3) AS r FROM base_whole WHERE t IS NOT NULL),
base_parts AS (SELECT u, scheme, scheme || '://' || split_part(split_part(r, '/', 1), '?', 1) AS origin, split_part(substr(r, length(split_part(split_part(r, '/', 1), '?', 1)) + 1), '?', 1) AS path FROM base_cut),
base_of AS (SELECT * FROM base_parts UNION ALL SELECT * FROM own_parts ANTI JOIN base_parts USING (u)),
whole AS (SELECT u, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN origin || t WHEN starts_with(t, '?') THEN origin || CASE WHEN path = '' THEN '/' ELSE path END || t
  ELSE origin || CASE WHEN path = '' THEN '/' ELSE '' END || substr(path, 1, length(path) - strpos(reverse(path), '/') + 1) || t END AS t FROM base_of JOIN (SELECT url AS u, d AS t FROM found JOIN decoded USING (t)) USING (u) WHERE t <> '' AND NOT starts_with(t, '#')),
raw AS (SELECT u FROM own UNION SELECT t FROM whole WHERE regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://')),
raw_cut AS (SELECT u, lower(split_part(u, '://', 1)) AS scheme, split_part(substr(u, strpos(u, '://') + 3), '#', 1) AS r FROM raw),
raw_parts AS (SELECT u, scheme, translate(split_part(split_part(r, '/', 1), '?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, split_part(substr(r, length(split_part(split_part(r, '/', 1), '?', 1)) + 1), '?', 1) AS path, CASE WHEN strpos(r, '?') > 0 THEN substr(r, strpos(r, '?')) ELSE '' END AS query FROM raw_cut),
dots(p, q) AS (SELECT DISTINCT path, CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END FROM raw_parts UNION ALL SELECT p, CASE WHEN regexp_matches(q, '/\.(/|$)') THEN regexp_replace(q, '/\.(/|$)', '/') ELSE regexp_replace(q, '(/[^/]*)?/\.\.(/|$)', '/') END FROM dots WHERE regexp_matches(q, '/\.\.?(/|$)')),
flat AS (SELECT p, q FROM dots WHERE NOT regexp_matches(q, '/\.\.?(/|$)')),
nodes AS (SELECT u, scheme || '://' || CASE WHEN ends_with(h, ':') THEN h[:-2] WHEN scheme = 'http' AND ends_with(h, ':80') THEN h[:-4] WHEN scheme = 'https' AND ends_with(h, ':443') THEN h[:-5] ELSE h END || q || query AS n FROM raw_parts JOIN flat ON path = p),
e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM whole JOIN nodes a USING (u) JOIN nodes b ON b.u = whole.t),
sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
walk(a, b) AS (SELECT a, b FROM sym UNION SELECT walk.a, sym.b FROM walk JOIN sym ON walk.b = sym.a),
every AS (SELECT url AS u FROM pages UNION SELECT b FROM walk),
rest AS (SELECT u, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS r FROM every),
cut AS (SELECT u, r, split_part(split_part(split_part(r, '/', 1), '?', 1), '#', 1) AS h FROM rest),
placed AS (SELECT u, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(split_part(split_part(substr(r, length(h) + 1), '?', 1), '#', 1), '') AS path FROM cut),
fitting AS (SELECT u, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM placed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY u),
told AS (SELECT a, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS passes_block FROM walk JOIN fitting ON b = u GROUP BY a)
SELECT page_id, placed.host, placed.path, fitting.rule, coalesce(fitting.action, CASE WHEN passes_block THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN placed ON placed.u IS NOT DISTINCT FROM pages.url LEFT JOIN fitting ON fitting.u = pages.url LEFT JOIN nodes ON nodes.u = pages.url LEFT JOIN told ON a = nodes.n"""
