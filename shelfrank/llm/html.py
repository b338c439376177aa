"""Main text of web pages by consensus of host: containers are scored page by page, their paths win votes by host, pages are read again by them.

A container is scored by the text in it that is the page's own: not aside by its names, not mostly links, and not said on half
of the host's pages. So strips and lines that a site puts on every page don't widen what is voted for.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import cut, if_small, ship
from shelfrank.llm.urls import parts

#: Elements whose content is no text; that never hold anything; that hold containers; that part blocks.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select datalist button head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body aside nav header footer form fieldset dialog menu figure details center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre address hgroup summary figcaption hr legend html".split())
#: Elements, and words of class, id and role, that mark what is not the article.
ASIDE = frozenset("nav aside header footer form menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead "
    "cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription social share sharing comment comments disqus respond reply replies related "
    "recommended form search login signup copyright legal disclaimer widget toolbar pagination pager contentinfo complementary alert".split()
)
#: Of those elements, the ones that some sites put around a whole page: they are aside unless they hold the article.
WRAPPERS = frozenset("header form dialog".split())
#: Begins of parts of a class, id or role that mark reader comments wherever they stand in a name.
COMMENT_WORDS = ("comment", "disqus")
#: Parts of a class, id or role that tell of the page's state: "no-sidebar" is no sidebar.
STATES = frozenset("no non not without with has have is hide show open opened closed enabled disabled".split())
#: Elements that no class word makes aside.
MAIN = frozenset("article main".split())
#: A start tag of these ends an open element of those, if none of these last is open in between.
CELLS = frozenset(("table",))
LISTS = BLOCKS - frozenset("div p address li dt dd".split())
CLOSES = {"li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, LISTS), "dd": ({"dt", "dd"}, LISTS), "tr": ({"tr"}, CELLS), "td": ({"td", "th"}, CELLS | {"tr"}), "th": ({"td", "th"}, CELLS | {"tr"})}

#: Text that so many pages of a host have, and at least half of them, is the host's and not a page's.
RECURS = 4

#: A path is used if it has at least a tenth of its host's votes; so there are ten at most.
SHARE = 10

#: A tag, with quoted values and without regard to quotes. Neither goes back over what it has passed.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+(?>"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_TAG_START = re.compile(r"/?[a-zA-Z]")
_RAW_END = {tag: re.compile(rf"</{tag}(?:\s[^>]*+)?/?>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)|(?=\s|/|$))""", re.I | re.S)
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}+|[xX][0-9a-fA-F]{9,}+);?")


def _named_aside(names: str) -> bool:
    """Whether a whole name of a class, id or role, or its last part, is a word for what is not the article, or any part one for comments."""
    for name in names.split():
        parts_of = re.findall(r"[a-z]+", name)
        if parts_of and STATES.isdisjoint(parts_of) and (parts_of[-1] in ASIDE_WORDS or any(p.startswith(COMMENT_WORDS) for p in parts_of)):
            return True
    return False


def _plain(text: str) -> str:
    """Character references decoded, and each run of white space as one space. A number too long for any character is U+FFFD."""
    if "&" in text:
        text = unescape(_LONG_REFERENCE.sub("\ufffd", text))
    return " ".join(text.split())


class Blocks(list):
    """The text blocks of a page in order: number of the container's path, whether it is aside from the article, characters in links, text.

    Paths are nodes of a tree, so that a deep page takes no more room than its tags; a parent has a smaller number than its children.
    """

    def __init__(self):
        super().__init__()
        self.parent, self.step, self.known = [-1], [""], {}

    def below(self, parent: int, step: str) -> int:
        """The path one step below another."""
        new = self.known.setdefault((parent, step), len(self.parent))
        if new == len(self.parent):
            self.parent.append(parent)
            self.step.append(step)
        return new

    def name(self, path: int) -> str:
        steps = []
        while path >= 0:
            steps.append(self.step[path])
            path = self.parent[path]
        return "/".join(reversed(steps))

    def find(self, name: str) -> int | None:
        """The path of a name; None if the page has no such path."""
        path: int | None = 0
        for step in name.split("/")[1:]:
            path = self.known.get((path, step))
            if path is None:
                break
        return path

    def inside(self, path: int) -> list[bool]:
        """Which paths are a path or lie below it."""
        out = [False] * len(self.parent)
        for i in range(path, len(out)):
            out[i] = i == path or self.parent[i] >= 0 and out[self.parent[i]]
        return out

    def holder(self, paths: list[int]) -> int:
        """The deepest path that holds all of these."""
        held = [0] * len(self.parent)
        for i in paths:
            held[i] += 1
        for i in range(len(held) - 1, 0, -1):
            if held[i] == len(paths):
                return i  # whatever holds all lies above it
            held[self.parent[i]] += held[i]
        return 0


def blocks(page: str) -> Blocks:
    """The text blocks of a page, in time that grows with its length whatever its tags.

    Elements that their names make aside are so unless they hold more than half of the page's good text and are the article's place:
    an article, main or h1 is in them, or no good text is in an article or main elsewhere. Where a quoted value would hide the end of
    every later tag, quotes mean nothing from that tag on.
    """
    out = Blocks()
    in_main: list[bool] = []
    # tag, path, aside, in article or main, number among the elements that names make aside; only elements that part blocks
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]
    opened: Counter = Counter()
    named: list[list[int]] = []  # blocks before its begin and its end, places of an article before its begin and its end
    places = 0
    text: list[str] = []
    linked, in_link, at, seek, quotes, unclosed = 0, False, 0, 0, True, set()
    end_of_tags = page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if text:
            if value := _plain("".join(text)):
                _, path, aside, main, _ = stack[-1]
                out.append((path, aside, min(linked, len(value)), value))
                in_main.append(main)
            text.clear()
        linked = 0

    def pop() -> str:
        tag, _, _, _, number = stack.pop()
        opened[tag] -= 1
        if number >= 0:
            named[number][1], named[number][3] = len(out), places
        return tag

    def close(tags: set, stops: frozenset) -> None:
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    while len(stack) > i:
                        pop()
                    return
                if stack[i][0] in stops:
                    return

    def said(end: int) -> None:
        nonlocal linked
        if end > at:
            text.append(page[at:end])
            if in_link:
                linked += len(page[at:end].strip())

    while (start := page.find("<", seek)) >= 0:
        if page.startswith("<!--", start):
            said(start)
            end = page.find("-->", start + 2)
            at = seek = len(page) if end < 0 else end + 3
            continue
        if start > end_of_tags:
            break
        if page.startswith(("<!", "<?"), start):
            said(start)
            at = seek = page.find(">", start) + 1
            continue
        if not _TAG_START.match(page, start + 1):
            seek = start + 1
            continue
        said(start)
        m = quotes and _TAG.match(page, start)
        if not m:
            quotes, m = False, _PLAIN_TAG.match(page, start)
        at = seek = m.end()
        end, tag, rest = m[1], m[2].lower(), m[3]
        if tag in RAW:
            text.append(" ")
            if not end and not rest.endswith("/") and tag not in unclosed:
                if closing := _RAW_END[tag].search(page, at, end_of_tags + 1):
                    at = seek = closing.end()
                elif tag in ("script", "style"):
                    at = seek = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            in_link = not end
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        in_link = False
        if end:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if stack[-1][0] == "p":
            pop()
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in VOID or tag in ("html", "body"):
            continue
        _, path, aside, main, _ = stack[-1]
        number, main = -1, main or tag in MAIN
        marks = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(rest)} if rest else {}
        places += tag in MAIN or tag == "h1"
        if not aside and not (tag == "header" and main):
            wrapper = tag in WRAPPERS
            aside = tag in ASIDE and not wrapper or "hidden" in marks
            if wrapper or marks and tag not in MAIN and _named_aside(" ".join(marks.get(k, "") for k in ("class", "id", "role"))):
                number = len(named)
                named.append([len(out), -1, places - (tag == "h1"), -1])
        if tag in CONTAINERS:
            names = sorted(re.sub(r"\d+", "N", c) for c in marks.get("class", "").split())
            path = out.below(path, tag + "".join(f".{c}" for c in names).replace("/", ""))
        opened[tag] += 1
        stack.append((tag, path, aside, main, number))
    said(len(page))
    flush()
    while len(stack) > 1:
        pop()
    if named:
        worth, of_main = [0], [0]
        for (_, aside, links, value), main in zip(out, in_main):
            good = max(0, len(value) - 2 * links) * (not aside)
            worth.append(worth[-1] + good)
            of_main.append(of_main[-1] + good * main)
        change = [0] * (len(out) + 1)
        for a, z, before, after in named:
            if not (2 * (worth[z] - worth[a]) > worth[-1] and (after > before or of_main[-1] == of_main[z] - of_main[a])):
                change[a] += 1
                change[z] -= 1
        out[:] = [(path, aside or around > 0, links, value) for (path, aside, links, value), around in zip(out, accumulate(change))]
    return out


def digest(value: str) -> int:
    """A 63-bit hash of a block's text."""
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest()) >> 1


def _good(found: Blocks, common: frozenset[int] = frozenset()) -> list[int]:
    """Paths of a page's good text: not aside, not mostly links, nor common to the host, unless that is more than half of it.

    If there is none, of what an article or main has that isn't aside.
    """
    good = [(path, value) for path, aside, linked, value in found if not aside and len(value) > 2 * linked]
    if common:
        own = [(path, value) for path, value in good if digest(value) not in common]
        if 2 * sum(len(value) for _, value in own) >= sum(len(value) for _, value in good):
            good = own
    if good:
        return [path for path, _ in good]
    main = [False] * len(found.parent)
    for i in range(1, len(main)):
        main[i] = main[found.parent[i]] or found.step[i].split(".")[0] in MAIN
    return [path for path, aside, _, _ in found if not aside and main[path]]


def best_path(found: Blocks, common: frozenset[int] = frozenset()) -> str | None:
    """The deepest container path that holds all of a page's good text; None without such text."""
    good = _good(found, common)
    return found.name(found.holder(good)) if good else None


def read(found: Blocks, winners: list[str], common: frozenset[int] = frozenset()) -> str:
    """The blocks below the first winning path that holds all of the page's good text, else below the page's own best path.

    What a winner doesn't hold is left out, so a host's common lines beside the article go. A page without good text is read by
    the first winning path that it has.
    """
    own = best_path(found, common)
    for name in [*(w for w in winners if own is None or f"{own}/".startswith(f"{w}/")), own]:
        path = None if name is None else found.find(name)
        if path is not None:
            inside = found.inside(path)
            if got := [value for i, aside, _, value in found if not aside and inside[i]]:
                return "\n".join(got)
    return ""


class _Sets(dict):
    """The sets of lists, each made once."""

    def __missing__(self, key: tuple) -> frozenset:
        if len(self) > 1000:
            self.clear()
        out = self[key] = frozenset(key)
        return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty page has an empty text; a null url counts as a host of its own. Malformed pages are read as far as their
    tags tell. Repeated rows vote as often as they occur and get equal texts. An empty table gives an empty one; other columns
    are not touched. Pages are read as a whole. The rows of one host are never gathered: votes are counts.
    """
    spark = pages.sparkSession
    ship(spark)
    host, _ = parts(F.col("url"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))

    def said(batches):
        for batch in batches:
            each = [{digest(v) for _, aside, linked, v in blocks(x.as_py()) if not aside and len(v) > 2 * linked} for x in batch.column("html")]
            hosts = batch.column("host").take(pa.array([i for i, x in enumerate(each) for _ in x], pa.int64()))
            yield pa.RecordBatch.from_arrays([hosts, pa.array([v for x in each for v in x], pa.int64())], ["host", "block"])

    # of a host's pages each has few of these, for half of the pages must hold one: the list of a host is about twice a page's at most
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages"))
    often = rows.select("host", "html").mapInArrow(said, "host string, block long").groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS)
    common = often.join(sizes, "host").where(2 * F.col("n") >= F.col("pages")).groupBy("host").agg(F.array_sort(F.collect_list("block")).alias("common"))
    rows = rows.join(if_small(cut(common)), "host", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))

    def vote(batches):
        sets = _Sets()
        for batch in batches:
            best = [best_path(blocks(x.as_py()), sets[tuple(c.as_py())]) for x, c in zip(batch.column("html"), batch.column("common"))]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(best, pa.string())], ["host", "path"])

    votes = cut(rows.select("host", "html", "common").mapInArrow(vote, "host string, path string").where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes")))
    cast = votes.groupBy("host").agg(F.sum("votes").alias("cast"))
    won = votes.join(cast, "host").where(F.col("votes") * SHARE >= F.col("cast"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    winners = cut(won.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("winners")))

    def take(batches):
        sets = _Sets()
        for batch in batches:
            out = [read(blocks(x.as_py()), w.as_py() or [], sets[tuple(c.as_py())]) for x, w, c in zip(*(batch.column(n) for n in ("html", "winners", "common")))]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    joined = rows.join(if_small(winners), "host", "left").select("page_id", "url", "html", "winners", "common")
    return joined.mapInArrow(take, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
