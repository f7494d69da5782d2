"""Main text of pages by templates that the pages of a host share.

Tokens of a page are its block elements, opened and closed, each told apart by the
elements around it, and the texts outside a declared article. A token's occurrence
vector holds how often each page of the host has it; vectors are compared by two 64-bit
fingerprints that tasks add up on their own, so no host is ever in one place. Tokens of
equal vectors, on enough pages, are an equivalence class. A class is valid if it holds an
element with its end and if on every page its tokens come in one order, over and over; classes that
lie in several gaps of those around them are taken apart first. Valid classes, nested so,
are the template of the host. Its elements are slots; what a slot is (article, other content, or
menu, advert and so on) is decided for each host by its elements and by how much of
its text, over all pages, is links. Texts that belong to a valid class are part of the template.
A page's main text is what fills its article slots, or other content if it has none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits, small_or_not, written

BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page.
UNSEEN = "script|style|noscript|template|iframe|object|svg|textarea|title|canvas|audio|video"
ASIDE = set("nav aside footer form button select menu dialog".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words in a class or id that say what an element is; those of the second list say nothing inside an article.
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer copyright"
    " cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations"
    " comment comments reply replies respond disqus login search pagination pager toolbar skip".split()
)
HEAD_WORDS = set("header masthead banner topbar".split())
ARTICLE, MAIN, BOILER = 1, 2, 4
#: What opening an element ends that was left open, and how far up that looks.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_LEX = re.compile(rf"<!--.*?(?:-->|\Z)|<({UNSEEN})\b[^<>]*>.*?(?:</\1\s*>|\Z)|</?[a-z](?:[^<>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+>|<[!?][^<>]*>", re.S | re.I)
_NAME = re.compile(r"</?([a-z][^\s/>]*)", re.I)
_ATTR = re.compile(r"\s(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MASK = (1 << 64) - 1


def signature(tag: str) -> tuple[str, str, int, bool]:
    """(name, what tells its element apart, ARTICLE, MAIN or BOILER, said by the head of a page only)."""
    name = _NAME.match(tag)[1].lower()
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_ATTR.finditer(tag)))} if " " in tag or "\n" in tag or "\t" in tag else {}
    if name in ("html", "body"):
        return name, name, 0, False
    told = re.sub(r"\d{2,}", "0", " ".join([name, *found.get("class", "").split(), "#" + found.get("id", "")]))
    role, names = found.get("role", "").lower(), [*found.get("class", "").split(), found.get("id", "")]
    if name == "article" or "articlebody" in found.get("itemprop", "").lower():
        return name, told, BOILER if any(c.lower() in ASIDE_WORDS for c in names) else ARTICLE, False
    if name == "main" or role == "main":
        return name, told, MAIN, False
    words = set()
    for c in names:
        parts = [w.lower() for w in _PARTS.findall(c)]
        if parts and parts[0] not in ("no", "with", "without", "has"):
            words.update(parts)
    if name in ASIDE or role in ASIDE_ROLES - {"banner"} or words & ASIDE_WORDS:
        return name, told, BOILER, False
    if name == "header" or role == "banner" or words & HEAD_WORDS:
        return name, told, BOILER, True
    return name, told, 0, False


class Walk:
    """One pass over a page: `seen` gets every token in order as (token, kind, up, flags)
    and `texts` every block of text as (element, text, links, rank). kind is 0 for an
    element, 1 for its end, 2 for a text. `labels` are ranks by token, which elements
    without one take from the element around or from what they are."""

    def __init__(self, labels: dict[int, int] | None = None):
        self.labels = labels or {}
        self.known: dict[str, tuple[str, str, int, bool]] = {}

    def __call__(self, page: str) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, str, int, int]]]:
        seen: list[tuple[int, int, int, int]] = []
        texts: list[tuple[int, str, int, int]] = []
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, 1)]  # name, token, flags, rank
        count: dict[str, int] = {}
        buffer: list[str] = []
        links = 0  # characters inside links so far in this block
        link_at = 0  # depth at which a link was opened

        def flush():
            nonlocal links
            if buffer:
                text = " ".join(entities.unescape("".join(buffer)).split())
                if text:
                    _, token, flags, rank = stack[-1]
                    own = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), token)
                    if self.labels.get(own) == 0:
                        rank = 0
                    texts.append((token, text, min(links, len(text)), rank))
                    if not flags & ARTICLE:
                        seen.append((own, 2, token, flags))
                buffer.clear()
            links = 0

        def pop():
            nonlocal link_at
            name, token, flags, _ = stack.pop()
            count[name] -= 1
            seen.append((~token & _MASK, 1, token, flags))
            if len(stack) < link_at:
                link_at = 0

        def words(piece: str):
            nonlocal links
            buffer.append(piece)
            if link_at:
                links += len(piece)

        at = 0
        for m in _LEX.finditer(page):
            if m.start() > at:
                words(page[at : m.start()])
            at = m.end()
            tag = m[0]
            if m[1] or tag[1] in "!?":
                continue
            if tag not in self.known:
                if len(self.known) > 20_000:
                    self.known.clear()
                self.known[tag] = signature(tag)
            name, told, own, head = self.known[tag]
            closing = tag[1] == "/"
            if name == "br":
                buffer.append(" ")
            elif name == "a":
                link_at = 0 if closing else len(stack)
            elif name in BLOCKS:
                flush()
                if closing:
                    if count.get(name):
                        while stack[-1][0] != name:
                            pop()
                        pop()
                    continue
                if name == "hr" or name in ("html", "body") and count.get(name):
                    continue
                if stack[-1][0] == "p":
                    pop()
                if name in ENDS and any(count.get(e) for e in ENDS[name][0]):
                    same, stop = ENDS[name]
                    k = len(stack) - 1
                    while stack[k][0] not in same and stack[k][0] not in stop and k:
                        k -= 1
                    while k and len(stack) > k and stack[k][0] in same:
                        pop()
                _, up, flags, rank = stack[-1]
                if own and not (head and flags & (ARTICLE | MAIN)) and not flags & BOILER:
                    flags |= own
                    rank = ranked(flags)
                token = xxhash.xxh64_intdigest(told.encode("utf-8", "replace"), up)
                stack.append((name, token, flags, self.labels.get(token, rank)))
                count[name] = count.get(name, 0) + 1
                seen.append((token, 0, up, flags))
        if at < len(page):
            words(page[at:])
        flush()
        while len(stack) > 1:
            pop()
        return seen, texts


def ranked(flags: int) -> int:
    """0 for what is no main text, 3 inside an article, 2 inside a main part, else 1."""
    return 0 if flags & BOILER else 3 if flags & ARTICLE else 2 if flags & MAIN else 1


def _signed(tokens: list[int]) -> pa.Array:
    return pa.array([t - (1 << 64) if t >> 63 else t for t in tokens], pa.int64())


TOKENS = "row long, host string, token long, kind int, up long, flags int, n long, at array<int>, chars long, linked long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each page with their places; an element with the characters
    directly in it. A token 0 stands for the page itself."""
    walk = Walk()
    for batch in batches:
        cols: list[list] = [[] for _ in range(10)]
        for row, host, page in zip(*(batch.column(k).to_pylist() for k in ("row", "host", "html")), strict=True):
            seen, texts = walk(page or "")
            found: dict[int, list] = {0: [3, 0, 0, [0], 0, 0]}
            for place, (token, kind, up, flags) in enumerate(seen):
                if token in found:
                    found[token][3].append(place)
                else:
                    found[token] = [kind, up, flags, [place], 0, 0]
            for token, text, links, _ in texts:
                if token in found:
                    found[token][4] += len(text)
                    found[token][5] += links
            for token, (kind, up, flags, at, chars, linked) in found.items():
                for col, v in zip(cols, (row, host, token, kind, up, flags, len(at), at, chars, linked), strict=True):
                    col.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), _signed(cols[2]), pa.array(cols[3], pa.int32()), _signed(cols[4]), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.list_(pa.int32())), pa.array(cols[8], pa.int64()), pa.array(cols[9], pa.int64())],
                ["row", "host", "token", "kind", "up", "flags", "n", "at", "chars", "linked"],
            )


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.when(host != "", host)


def candidates(tokens: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(host, token, class, kind, up, flags) of tokens in classes that hold an element and
    its end, and all tokens that are on enough pages of their host with their sums."""
    one, two = F.bit_xor(F.xxhash64("row", "n")).alias("v1"), F.bit_xor(F.xxhash64("n", "row", F.lit(7))).alias("v2")
    each = tokens.groupBy("host", "token").agg(
        F.count("*").alias("pages"), one, two, F.min("kind").alias("kind"), F.min("up").alias("up"), F.min("flags").alias("flags"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    each = written(each.where("pages > 1"), "vectors")
    hosts = each.where("kind = 3").select("host", F.col("pages").alias("host_pages"))
    often = each.where("kind < 3").join(small_or_not(hosts), "host").where(F.col("pages") >= F.col("host_pages") * share)
    often = written(often.withColumn("class", F.xxhash64("host", "v1", "v2")), "frequent")
    whole = often.groupBy("host", "class").agg(F.count_if(F.col("kind") == 0).alias("opened"), F.count_if(F.col("kind") == 1).alias("ended"))
    whole = whole.where("opened > 0 and ended > 0").select("host", "class")
    return often.join(whole, ["host", "class"], "left_semi").select("host", "token", "class", "kind", "up", "flags"), often


PLACED = "host string, token long, class long, kind int, flags int"


def _placed(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
    """Splits the classes of one host by the gap they lie in: a token belongs to the top
    element that it hangs from within its class, and that to the element around it. What
    has neither an element with its end, nor is a text, goes."""
    rows = members.to_pylist()
    by = {r["token"]: r for r in rows}
    gap: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: r["token"]):
        way = []
        while r["token"] not in gap and r["up"] in by and by[r["up"]]["class"] == r["class"]:
            way.append(r["token"])
            r = by[r["up"]]
        end = gap.setdefault(r["token"], r["up"])
        gap.update(dict.fromkeys(way, end))
    kinds: dict[tuple[int, int], set[int]] = {}
    for r in rows:
        kinds.setdefault((r["class"], gap[r["token"]]), set()).add(r["kind"])
    out = []
    for r in rows:
        of = (r["class"], gap[r["token"]])
        if {0, 1} <= kinds[of] or kinds[of] == {2}:
            own = xxhash.xxh64_intdigest(f"{of[0]} {of[1]}")
            out.append({k: r[k] for k in ("host", "token", "kind", "flags")} | {"class": own - (1 << 64) if own >> 63 else own})
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("class", pa.int64()), ("kind", pa.int32()), ("flags", pa.int32())])
    return pa.Table.from_pylist(out, schema=schema)


def nested(members: DataFrame) -> DataFrame:
    """(host, token, class, kind, flags): classes split by the gap of the class around
    them. A group is the template of a host: some hundred tokens, whatever its pages."""
    return members.groupBy("host").applyInArrow(_placed, PLACED)


def valid_classes(tokens: DataFrame, members: DataFrame) -> DataFrame:
    """(host, class) of classes that keep one order on every page."""
    # order: the tokens of a page, by place, are one sequence repeated
    small = small_or_not(members.select("host", "token", "class"))
    placed = tokens.where("kind < 3").join(small, ["host", "token"])
    page = placed.groupBy("row", "host", "class").agg(
        F.transform(F.sort_array(F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p.alias("p"), F.col("token").alias("t")))))), lambda e: e["t"]).alias("seq"), F.count("*").alias("k")
    )
    first = F.slice("seq", F.lit(1), F.col("k").cast("int"))
    whole = F.flatten(F.array_repeat(first, (F.size("seq") / F.col("k")).cast("int")))
    page = page.select("host", "class", (whole == F.col("seq")).alias("ok"), F.xxhash64(first).alias("order"))
    orders = page.groupBy("host", "class").agg((F.bool_and("ok") & (F.min("order") == F.max("order"))).alias("ordered"))
    return orders.where("ordered").select("host", "class")


def slot_labels(pages: DataFrame, share: float = 0.1, link_share: float = 0.5) -> DataFrame:
    """(host, labels): for each host with two pages or more the ranks of its template's
    elements and texts, from (row, host, html) without null hosts. A token counts where
    it is on `share` of the host's pages at least, so a host has a bounded number."""
    tokens = written(pages.mapInArrow(_tokens, TOKENS), "tokens")
    members, often = candidates(tokens, share)
    members = written(nested(members), "classes")
    template = members.join(small_or_not(valid_classes(tokens, members)), ["host", "class"], "left_semi")
    flags = F.col("flags")
    rank = F.when(flags.bitwiseAND(BOILER) > 0, 0).when(flags.bitwiseAND(ARTICLE) > 0, 3).when(flags.bitwiseAND(MAIN) > 0, 2).otherwise(1)
    slots = template.where("kind = 0").select("host", "token", rank.alias("rank"))
    fixed = template.where("kind = 2").select("host", "token", F.lit(0).alias("rank"))
    listed = often.where((F.col("kind") == 0) & (F.col("chars") > 0) & (F.col("linked") >= F.col("chars") * link_share) & (flags.bitwiseAND(ARTICLE | MAIN) == 0))
    both = slots.unionByName(fixed).unionByName(listed.select("host", "token", F.lit(0).alias("rank")))
    both = both.groupBy("host", "token").agg(F.min("rank").alias("rank"))
    return written(both.groupBy("host").agg(F.collect_list(F.struct("token", "rank")).alias("labels")), "labels")


def main_text(page: str, labels: dict[int, int] | None = None, walk: Walk | None = None) -> str:
    """The blocks of the highest rank that the page has, one a line."""
    walk = walk or Walk()
    walk.labels = labels or {}
    _, texts = walk(page)
    best = max((rank for *_, rank in texts), default=0)
    return "\n".join(text for _, text, _, rank in texts if rank == best) if best else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = Walk()
    for batch in batches:
        out = []
        for page, labels in zip(batch.column("html").to_pylist(), batch.column("labels").to_pylist(), strict=True):
            ranks = {e["token"] & _MASK: e["rank"] for e in labels or ()}
            out.append(main_text(page or "", ranks, walk))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.1, salts: int = 16) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row: the main text of its page.

    Inside an article nothing is left out but menus, footers, adverts, forms, comments and
    the like; what many articles share stays. A null page is empty, and so is one without
    text. Pages whose address has no host, or whose host has no other page, are read by their
    own elements alone. White space is what Unicode calls so; a <br> is white space. Rows that
    repeat are pages of their own; ids may be null; an empty table gives an empty one; other
    columns are not looked at.
    """
    arrow_limits(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    pages = rows.where("host is not null").select(F.monotonically_increasing_id().alias("row"), "host", "html")
    labels = slot_labels(pages, share)
    if labels.limit(salts * 1000 + 1).count() <= salts * 1000:
        joined = rows.join(F.broadcast(labels), "host", "left")
    else:  # a host with very many pages is dealt out
        spread = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "labels").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
