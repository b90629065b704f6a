"""URL, scope, robots and sitemap expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.history import only_top
from corpuslake.session import keep


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_url(url: Column | str) -> Column:
    """http(s) only, no credentials; scheme and host in lower case, default port and fragment dropped, an empty path as ``/``; else null."""
    u = F.trim(_c(url))
    parts = r"^(?i:(https?))://([^/?#@\s]+?)(?::([0-9]*))?(/[^?#\s]*)?(\?[^#\s]*)?(#.*)?$"
    g = lambda i: F.regexp_extract(u, parts, i)
    scheme = F.lower(g(1))
    port = F.when((g(3) == "") | ((scheme == "http") & (g(3) == "80")) | ((scheme == "https") & (g(3) == "443")), "").otherwise(F.concat(F.lit(":"), g(3)))
    return F.when(u.rlike(parts), F.concat(scheme, F.lit("://"), F.lower(g(2)), port, F.when(g(4) == "", "/").otherwise(g(4)), g(5)))


def origin_key(url: Column | str) -> Column:
    """scheme://host[:port] of a normalised URL; IPv6 hosts keep their brackets."""
    return F.nullif(F.regexp_extract(normalize_url(url), r"^(https?://[^/]+)/", 1), F.lit(""))


def url_path(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(normalize_url(url), r"^https?://[^/]+(/[^?]*)", 1), F.lit(""))


def schedule_key(url: Column | str, group: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("group:"), _c(group)), origin_key(url))


def sha256_id(prefix: str, *parts: Column | str) -> Column:
    """SHA-256 of the prefix and parts, each ended or joined by NUL: ids that derive from content."""
    return F.sha2(F.concat_ws("\x00", F.lit(prefix), *map(_c, parts)), 256)


def owner_of(urls: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """The first source (by ordinal) that owns each URL, or null.

    sources: ordinal, source_id, allowed_origins, path_prefixes, deny_prefixes, allowed_urls (null: no list). Sources are joined on their
    exploded origins, so nothing but rows of the same origin is compared.
    """
    u = urls.withColumns({"__url": normalize_url(url), "__origin": origin_key(url), "__path": url_path(url)})
    s = sources.select("ordinal", "source_id", "path_prefixes", "deny_prefixes", "allowed_urls", F.explode("allowed_origins").alias("__origin"))
    inside = F.exists("path_prefixes", lambda p: F.col("__path").startswith(p)) & ~F.exists(F.coalesce("deny_prefixes", F.array().cast("array<string>")), lambda p: F.col("__path").startswith(p))
    owns = inside & (F.col("allowed_urls").isNull() | F.array_contains("allowed_urls", F.col("__url")))
    hit = u.select("__url", "__origin", "__path").distinct().join(s, "__origin").where(owns).groupBy("__url").agg(F.min_by("source_id", "ordinal").alias("owner"))
    return u.join(hit, "__url", "left").drop("__url", "__origin", "__path")


def overlapping_sources(sources: DataFrame) -> DataFrame:
    """Pairs of sources that share an origin and of whose path prefixes one holds the other.

    Each prefix meets the others by equality with one of its own beginnings, so that sources of an origin aren't compared pair by pair.
    """
    s = sources.select("ordinal", "source_id", F.explode("path_prefixes").alias("p"), "allowed_origins").select("ordinal", "source_id", "p", F.explode("allowed_origins").alias("origin"))
    starts = s.select("origin", F.struct("ordinal", "source_id").alias("x"), F.explode(F.transform(F.sequence(F.lit(0), F.length("p")), lambda n: F.substring(F.col("p"), F.lit(1), n))).alias("p"))
    j = starts.join(s.select("origin", "p", F.struct("ordinal", "source_id").alias("y")), ["origin", "p"]).where("x.ordinal <> y.ordinal")
    pair = F.array_sort(F.array("x", "y"))
    return j.select(pair[0]["source_id"].alias("left_source"), pair[1]["source_id"].alias("right_source")).distinct()


def sitemap_url_allowed(urls: DataFrame, sources: DataFrame, url: str = "url", origin: str | None = None) -> DataFrame:
    """Append ``sitemap_allowed``: some source of the origin (the URL's own, unless a column names it) has no sitemap prefixes or one that the URL starts with.

    sources: allowed_origins, sitemap_url_prefixes (null or empty: any).
    """
    s = sources.select(F.coalesce("sitemap_url_prefixes", F.array().cast("array<string>")).alias("__p"), F.explode("allowed_origins").alias("__o"))
    any_of = s.groupBy("__o").agg(F.bool_or(F.size("__p") == 0).alias("__any"), F.array_distinct(F.flatten(F.collect_list("__p"))).alias("__p"))
    u = urls.withColumn("__o", F.col(origin) if origin else origin_key(url))
    fits = F.col("__any") | F.exists("__p", lambda p: F.col(url).startswith(p))
    return u.join(any_of, "__o", "left").withColumn("sitemap_allowed", F.coalesce(fits, F.lit(False))).drop("__o", "__any", "__p")


def parse_robots(text: str) -> dict:
    """Groups of agents with their rules, and sitemaps; comments, unknown fields and rules before any agent are ignored."""
    groups, sitemaps, agents, rules = [], [], [], []
    for raw in (text or "").splitlines():
        name, colon, value = raw.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "sitemap":
            sitemaps.append(value)
        elif name == "user-agent":
            if rules:
                groups.append({"agents": agents, "rules": rules})
                agents, rules = [], []
            agents = [*agents, value.lower()]
        elif name in ("allow", "disallow") and agents:
            rules.append({"allow": name == "allow", "path": value})
    if agents:
        groups.append({"agents": agents, "rules": rules})
    return {"groups": groups, "sitemaps": sitemaps}


def robots_table(df: DataFrame, origin: str, text: str) -> DataFrame:
    """``origin, agent, allow, path``: one row per rule, by an Arrow UDF on whole files; an allow-all row stands for a group without rules."""
    schema = "array<struct<agent:string,allow:boolean,path:string>>"

    @F.udf(returnType=schema, useArrow=True)
    def rules(t):
        return [{"agent": a, "allow": r["allow"], "path": r["path"]} for g in parse_robots(t)["groups"] for a in g["agents"] for r in (g["rules"] or [{"allow": True, "path": "/"}])]

    return df.select(F.col(origin).alias("origin"), F.explode(rules(text)).alias("r")).select("origin", "r.agent", "r.allow", "r.path")


def robots_allows(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Append ``allowed``: rules of the agent's own group, else of ``*``; the longest matching prefix wins, allow wins ties, and nothing matching allows.

    An empty path matches nothing.
    """
    own = rules.where((F.col("agent") == agent.lower()) | (F.col("agent") == "*")).withColumn("specific", F.max((F.col("agent") != "*").cast("int")).over(Window.partitionBy("origin")))
    own = own.where("(specific = 1) = (agent <> '*')").select(F.col("origin").alias("__origin"), "allow", "path")
    u = urls.withColumns({"__origin": origin_key(url), "__path": url_path(url)})
    hit = u.select("__origin", "__path").distinct().join(own, "__origin").where((F.length("path") > 0) & F.col("__path").startswith(F.col("path")))
    best = hit.groupBy("__origin", "__path").agg(F.max_by("allow", F.struct(F.length("path"), "allow")).alias("allow"))
    return u.join(best, ["__origin", "__path"], "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("__origin", "__path", "allow")


def sitemap_locs(text: Column | str) -> Column:
    """Sorted distinct locations of a sitemap, entities decoded."""
    found = F.regexp_extract_all(_c(text), F.lit(r"(?is)<loc[^>]*>(.*?)</loc>"), 1)
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(F.trim(x), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, plain), lambda x: x != "")))


def is_sitemap_index(text: Column | str) -> Column:
    return _c(text).rlike(r"(?i)<sitemapindex[\s>]")


def language_tag(tag: Column | str) -> Column:
    """The tag if it has the form of a language tag, else null."""
    return F.when(_c(tag).rlike(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"), _c(tag))


def links_frontier(seeds: DataFrame, links: DataFrame, cap: int, max_depth: int = 20) -> DataFrame:
    """Breadth-first reach over ``links(url, target)`` from ``seeds(url)``: ``url, depth``; a level keeps its first ``cap`` URLs in byte order and depth ends at ``max_depth`` (the bounds of the frontier itself, not of this plan)."""
    seen = keep(seeds.select("url").distinct().orderBy("url").limit(cap).withColumn("depth", F.lit(0)), "frontier")
    for depth in range(1, max_depth + 1):
        fresh = links.join(seen.where(F.col("depth") == depth - 1).select("url"), "url").select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        level = keep(fresh.orderBy("url").limit(cap).withColumn("depth", F.lit(depth)), "frontier")
        if not level.head(1):
            break
        seen = keep(seen.unionByName(level), "frontier")
    return seen


def resolve_redirects(starts: DataFrame, hops: DataFrame, limit: int = 10, sources: DataFrame | None = None, rules: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """Follow ``hops(url, location)`` from each start: ``url, final_url, chain, outcome``, and with ``sources`` the ``owner`` of the last URL.

    Outcomes: ok, redirect_loop, redirect_limit_exceeded; with sources (see ``owner_of``) each hop must have an owner of its own, else redirect_outside_source_allowlist; with robots rules
    each must be allowed, else redirect_robots_denied. A location is resolved against the URL it came from and normalised where sources are given.
    """
    # One join a hop: a recursive query has a limit of rows.
    to = hops.select(F.col("url").alias("__from"), F.col("location").alias("__to"))
    if sources is not None:
        absolute = F.when(F.col("__to").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("__to")).when(F.col("__to").startswith("/"), F.concat(origin_key("__from"), "__to")).otherwise(F.concat(F.regexp_replace(F.regexp_replace("__from", r"[?#].*$", ""), r"[^/]*$", ""), "__to"))
        # Written between, as each of these expressions repeats the one before many times.
        to = keep(to.withColumn("__whole", absolute), "hops")
        to = keep(to.select("__from", "__to", F.coalesce(canonical_url("__whole"), "__to").alias("url")), "hops")
        to = owner_of(to, sources)
        to = robots_allows(to, rules, agent) if rules is not None else to.withColumn("allowed", F.lit(True))
        to = keep(to.select("__from", F.col("url").alias("__to"), F.col("owner").alias("__owner"), F.when(F.col("owner").isNull(), "redirect_outside_source_allowlist").when(~F.col("allowed"), "redirect_robots_denied").alias("__bad")), "hops")
    else:
        to = to.withColumns({"__owner": F.lit(None).cast("string"), "__bad": F.lit(None).cast("string")})
    first = starts.select("url").distinct()
    first = owner_of(first, sources).select("url", "owner") if sources is not None else first.withColumn("owner", F.lit(None).cast("string"))
    seen = F.array_contains("chain", F.col("__to"))
    # A hop out of the allowlist is rejected before a loop is, a loop before robots are asked.
    why = F.when(F.col("__bad") == "redirect_outside_source_allowlist", F.col("__bad")).when(seen, "redirect_loop").otherwise(F.col("__bad"))
    last = ["url", "at", "owner", "chain", "outcome"]
    walking = first.select("url", "owner", F.col("url").alias("at"), F.array("url").alias("chain"))
    done = None
    for hop in range(limit + 1):
        # Each hop is written, and only URLs that are still on their way take the next.
        stepped = keep(walking.join(to, F.col("at") == F.col("__from"), "left"), "hops")
        rest = stepped.where("__from IS NULL").withColumn("outcome", F.lit("ok"))
        if hop == limit:
            rest = rest.unionByName(stepped.where("__from IS NOT NULL").withColumn("outcome", F.lit("redirect_limit_exceeded")))
        moved = stepped.where("__from IS NOT NULL").select("url", F.col("__owner").alias("owner"), F.col("__to").alias("at"), F.array_append("chain", F.col("__to")).alias("chain"), why.alias("outcome"))
        done = rest.select(last) if done is None else done.unionByName(rest.select(last))
        if hop == limit or not moved.head(1):
            break
        done = done.unionByName(moved.where("outcome IS NOT NULL").select(last))
        walking = moved.where("outcome IS NULL").drop("outcome")
    ok = F.col("outcome") == "ok"
    out = done.select("url", F.when(ok, F.col("at")).alias("final_url"), "chain", "outcome", F.when(ok, F.col("owner")).alias("owner"))
    out = only_top(out, ["url"], [F.size("chain").desc(), F.col("outcome")])  # a URL with several locations ends once
    return out if sources is not None else out.drop("owner")


def expand_sitemaps(roots: DataFrame, entries: DataFrame, max_depth: int = 5, max_locations: int = 100_000, sources: DataFrame | None = None, rules: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """Page URLs under sitemap indexes, ``entries(sitemap, loc, is_index)`` from ``roots(sitemap)``, at most so deep; more than ``max_locations`` index locations of an origin are an error (the crawl's own bound).

    With ``sources`` a root or index location counts only on the origin of its root and where ``sitemap_url_allowed``, and a page only if a source owns it; with robots ``rules``, a sitemap is read
    only if they allow it. Levels are found one after the other, each written to the shared folder; a sitemap is read once for each origin, at its first level.
    """
    spot = roots.select("sitemap", origin_key("sitemap").alias("origin")).distinct()

    def asked(df: DataFrame) -> DataFrame:
        if sources is None:
            return df
        return sitemap_url_allowed(df.where(origin_key("sitemap").eqNullSafe(F.col("origin"))), sources, "sitemap", "origin").where("sitemap_allowed").drop("sitemap_allowed")

    level = asked(spot).withColumn("depth", F.lit(0))
    seen, counts = None, None
    for depth in range(max_depth + 1):
        level = keep(level, "sitemaps")
        counted = level.groupBy("origin").agg(F.count("*").alias("n"))
        counts = counted if counts is None else counts.unionByName(counted).groupBy("origin").agg(F.sum("n").alias("n"))
        if counts.where(F.col("n") > max_locations).head(1):
            raise ValueError(f"more than {max_locations} sitemap locations of an origin")
        seen = level if seen is None else keep(seen.unionByName(level), "sitemaps")
        if depth == max_depth or not level.head(1):
            break
        read = robots_allows(level, rules, agent, "sitemap").where("allowed").drop("allowed") if rules is not None else level
        fresh = read.join(entries.where("is_index"), "sitemap").select(F.col("loc").alias("sitemap"), "origin").distinct()
        level = asked(fresh).join(seen.select("sitemap", "origin"), ["sitemap", "origin"], "left_anti").withColumn("depth", F.lit(depth + 1))
    read = robots_allows(seen, rules, agent, "sitemap").where("allowed") if rules is not None else seen
    pages = read.select("sitemap").distinct().join(entries.where("NOT is_index"), "sitemap").select(F.col("loc").alias("url")).distinct()
    if sources is not None:
        pages = owner_of(pages, sources).where("owner IS NOT NULL")
    return pages.select(F.col("url").alias("loc"))


# ------------------------------------------------------------ whole URLs
# Fixed values of the URL standard: characters percent-encoded in a path and a query beyond ASCII's own controls and everything above it; forbidden in a host.
_PATH_SET, _QUERY_SET, _HOST_BAD = set(' "#<>?^`{}'), set(" \"#<>'"), set("\x00\t\n\r #/:<>?@[\\]^|%\x7f")


def _escaped(text: str, unsafe: set[str]) -> str:
    return "".join(c if "!" <= c <= "~" and c not in unsafe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _host(text: str) -> str | None:
    """A host as it is written in a normal URL: IPv6 compressed, IPv4 in dotted decimals, names in lower-case ASCII; null if it is none."""
    import ipaddress
    from urllib.parse import unquote

    if text.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]" if text.endswith("]") else None
        except ValueError:
            return None
    name = unquote(text, errors="replace")
    try:
        name = name.encode("idna").decode().lower() if not name.isascii() else name.lower()
    except UnicodeError:
        return None
    if not name or set(name) & _HOST_BAD or min(name) < " ":
        return None
    labels = name.removesuffix(".").split(".")
    if not re.fullmatch(r"[0-9]+|0x[0-9a-f]*", labels[-1]):
        return name
    if len(labels) > 4:
        return None
    numbers = []
    for x in labels:
        try:
            numbers.append(int(x[2:] or "0", 16) if x.startswith("0x") else int(x, 8) if len(x) > 1 and x[0] == "0" else int(x))
        except ValueError:
            return None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def parse_url(text: str | None) -> str | None:
    """An http(s) URL in its one normal form, or null: controls and tabs dropped, backslashes as slashes, credentials refused, host and port checked and written plainly, dot
    segments resolved, other characters percent-encoded, the default port and the fragment dropped."""
    if text is None:
        return None
    m = re.match(r"(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?", re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33))))), re.I)
    if not m or "@" in m[2]:
        return None
    scheme, spot = m[1].lower(), re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", m[2])
    host = _host(spot[1]) if spot else None
    port = int(spot[2]) if spot and spot[2] else None
    if host is None or port is not None and port > 65_535:
        return None
    parts: list[str] = []
    segments = re.split(r"[/\\]", m[3])[1:] or [""]
    for i, s in enumerate(segments):
        dots = s.lower().replace("%2e", ".")
        if dots == "..":
            del parts[-1:]
        if dots in (".", ".."):
            if i == len(segments) - 1:
                parts.append("")
        else:
            parts.append(_escaped(s, _PATH_SET))
    where = "" if port in (None, 443 if scheme == "https" else 80) else f":{port}"
    return f"{scheme}://{host}{where}/{'/'.join(parts)}{_escaped(m[4], _QUERY_SET) if m[4] else ''}"


def canonical_url(url: Column | str) -> Column:
    """``normalize_url`` for URLs of any form. What ``normalize_url`` reads as it stands never leaves the JVM; others are parsed in Arrow batches, as a standard URL parser would."""
    c = _c(url)
    plain = c.rlike(r"^https?://[a-z][a-z0-9.-]*[a-z](/[A-Za-z0-9_~!$&'()*+,;=:@|-][A-Za-z0-9_~!$&'()*+,;=:@|.-]*)*/?(\?[A-Za-z0-9_.~!$&()*+,;=:@/?|%-]*)?$")

    @F.udf(returnType="string", useArrow=True)
    def run(x):
        return parse_url(x)

    return F.when(plain, normalize_url(c)).otherwise(run(F.when(~plain, c)))
