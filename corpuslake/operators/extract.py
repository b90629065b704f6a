"""Page extraction and passages, as Arrow-batched functions over a tree."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.htmltree import Node, build, inner_text, walk
from corpuslake.functions.urls import sha256_id

# Elements that are never content, and those that make blocks.
NEVER = frozenset("head script style noscript template nav footer aside".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p pre li blockquote dt dd td th".split())
MINIMUM = 200


def hidden(x: Node) -> bool:
    a = x.attrs
    return x.tag in NEVER or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def blocks_of(scope: Node) -> list[dict]:
    """Headings, prose and code in order: outermost block elements only, hidden parts left out, white space kept in ``pre`` alone."""
    out, stack = [], [scope]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or hidden(x):
            continue
        if x.tag in BLOCKS:
            text = inner_text(x, hidden)
            code = x.tag == "pre"
            text = text.strip("\n") if code else " ".join(text.split())
            if text.strip():
                out.append({"kind": "code" if code else "heading" if x.tag[0] == "h" and x.tag[1:].isdigit() else "prose", "level": int(x.tag[1]) if x.tag[0] == "h" and x.tag[1:].isdigit() else 0, "text": text})
        else:
            stack += reversed(x.children)
    return out


def useful(blocks: list[dict]) -> int:
    return sum(len("".join(b["text"].split())) for b in blocks)


def _visible(x: Node) -> bool:
    while x is not None:
        if hidden(x):
            return False
        x = x.parent
    return True


def _links_share(x: Node) -> float:
    total = len("".join(inner_text(x, hidden).split()))
    linked = sum(len("".join(inner_text(a, hidden).split())) for a in walk(x) if a.tag == "a")
    return linked / total if total else 1.0


def extract(html: str | None, url: str, minimum: int = MINIMUM) -> dict:
    """The first of: the one visible main element, the scope with most useful characters and few links, the whole body, that has enough; and metadata."""
    if html is None:
        return {"error": "no body"}
    root = build(html)
    nodes = list(walk(root))
    mains = [x for x in nodes if (x.tag == "main" or x.attrs.get("role", "").lower() == "main") and _visible(x)]
    body = next((x for x in nodes if x.tag == "body"), root)
    scopes = [x for x in nodes if x.tag in ("article", "section", "div") and _visible(x)]
    candidates = [("main", mains[0])] if len(mains) == 1 else []
    ranked = sorted(((useful(blocks_of(x)), -i) for i, x in enumerate(scopes)), reverse=True)[:3]
    best = next((scopes[-i] for n, i in ranked if n and _links_share(scopes[-i]) < 0.5), None)
    if best is not None:
        candidates.append(("readability", best))
    candidates.append(("body", body))
    method, found = next(((m, b) for m, x in candidates if useful(b := blocks_of(x)) >= minimum), (None, []))
    base = next((urljoin(url, x.attrs["href"]) for x in nodes if x.tag == "base" and x.attrs.get("href")), url)
    title = next((t for x in nodes if x.tag == "title" and (t := " ".join(inner_text(x).split()))), None) or next((b["text"] for b in found if b["kind"] == "heading"), None)
    description = next((x.attrs["content"].strip() for x in nodes if x.tag == "meta" and (x.attrs.get("name") or x.attrs.get("property", "")).lower() in ("description", "og:description") and x.attrs.get("content", "").strip()), None)
    lang = next((x.attrs["lang"] for x in nodes if x.tag == "html" and x.attrs.get("lang")), None)
    canonical = next((urljoin(base, x.attrs["href"]) for x in nodes if x.tag == "link" and "canonical" in x.attrs.get("rel", "").lower().split() and x.attrs.get("href")), None)
    links = set()
    for x in nodes:
        if x.tag == "a" and x.attrs.get("href"):
            try:
                s = urlsplit(urljoin(base, x.attrs["href"].strip()))
            except ValueError:
                continue
            if s.scheme in ("http", "https") and s.netloc and "@" not in s.netloc:
                links.add(urlunsplit((s.scheme, s.netloc.lower(), s.path or "/", s.query, "")))
    return {
        "extraction_method": method, "title": title, "description": description, "language": lang, "canonical_url": canonical, "blocks": found, "content": "\n\n".join(b["text"] for b in found),
        "links": sorted(links), "useful_chars": useful(found), "error": None if method else "useful_content_below_minimum",
    }


EXTRACTED = "extraction_method string, title string, description string, language string, canonical_url string, blocks array<struct<kind:string,level:int,text:string>>, content string, links array<string>, useful_chars int, error string"


def extract_html(df: DataFrame, html: str = "html", url: str = "url", minimum: int = MINIMUM) -> DataFrame:
    """Append ``extracted struct``."""

    @F.udf(returnType=f"struct<{', '.join(x.replace(' ', ':', 1) for x in EXTRACTED.split(', '))}>", useArrow=True)
    def run(h, u):
        return extract(h, u or "", minimum)

    return df.withColumn("extracted", run(html, url))


# ------------------------------------------------------------ passages
def pack_passages(blocks: list[dict], max_tokens: int = 384) -> list[dict]:
    """Sections by heading stack; blocks packed greedily up to ``max_tokens`` words, a larger block split by line and then by words; no overlap."""
    out, path, current, size = [], [], [], 0

    def flush() -> None:
        nonlocal current, size
        if current:
            out.append({"ordinal": len(out), "heading_path": [t for _, t in path], "content": "\n\n".join(current)})
        current, size = [], 0

    def pieces(text: str) -> Iterator[str]:
        if len(text.split()) <= max_tokens:
            yield text
            return
        held: list[str] = []
        count = 0
        for line in text.split("\n"):
            words = line.split()
            if len(words) > max_tokens:
                if held:
                    yield "\n".join(held)
                    held, count = [], 0
                for a in range(0, len(words), max_tokens):
                    yield " ".join(words[a : a + max_tokens])
                continue
            if count + len(words) > max_tokens:
                yield "\n".join(held)
                held, count = [], 0
            held.append(line)
            count += len(words)
        if any(x.strip() for x in held):
            yield "\n".join(held)

    for b in blocks or []:
        if b["kind"] == "heading":
            flush()
            while path and path[-1][0] >= b["level"]:
                path.pop()
            path.append((b["level"], b["text"]))
            continue
        for piece in pieces(b["text"]):
            n = len(piece.split())
            if size + n > max_tokens:
                flush()
            current.append(piece)
            size += n
    flush()
    return out


def passages(pages: DataFrame, blocks: str = "blocks", page_id: str = "page_id", max_tokens: int = 384) -> DataFrame:
    """One row per passage: the page's columns but its blocks, with ordinal, heading_path, content and a content-derived passage_id."""

    @F.udf(returnType="array<struct<ordinal:int,heading_path:array<string>,content:string>>", useArrow=True)
    def run(b):
        return pack_passages([x if isinstance(x, dict) else x.asDict() for x in b] if b is not None else [], max_tokens)

    keep = [c for c in pages.columns if c not in (blocks, "ordinal", "heading_path", "content")]
    out = pages.select(*keep, F.explode(run(blocks)).alias("__p")).select(*keep, "__p.*")
    return out.withColumn("passage_id", sha256_id("passage", F.col(page_id).cast("string"), F.col("ordinal").cast("string"), "content"))


def line_blocks(text: str):
    """Lines of a text as prose blocks."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit("prose").alias("kind"), F.lit(0).alias("level"), x.alias("text")))


def admission(df: DataFrame) -> DataFrame:
    """The first failing rule of a raw response, or admitted: ``admission``.

    df: status_code, location, final_url, owned, loop, robots_allowed, content_type, body (binary), useful_chars, cpu_ms, hops.
    """
    from corpuslake.functions.urls import normalize_url

    body = F.col("body")
    redirect = F.col("status_code").between(300, 399)
    ladder = (
        (redirect & F.col("location").isNull(), "redirect_missing_location"), (normalize_url("final_url").isNull(), "url_not_normalizable"), (redirect & ~F.col("owned"), "redirect_outside_source_allowlist"), (F.col("loop"), "redirect_loop"),
        (redirect & ~F.col("robots_allowed"), "redirect_robots_denied"), ((F.col("content_type") != "") & ~F.lower("content_type").rlike("^(text/html|application/xhtml\\+xml)"), "non_html_content_type"),
        (F.octet_length(body) > 5 * 1024 * 1024, "body_limit_exceeded"), (~F.expr("is_valid_utf8(body)"), "body_decode_failed"), (F.col("useful_chars") < MINIMUM, "useful_content_below_minimum"),
        (F.col("cpu_ms") > 5_000, "extraction_cpu_budget_exceeded"), (F.col("hops") > 10, "redirect_limit_exceeded"),
    )
    out = F
    for c, name in ladder:
        out = out.when(F.coalesce(c, F.lit(False)), name)
    return df.withColumn("admission", out.otherwise("admitted"))

