"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template. A page is read as tokens: the block
elements with their path of names and classes, and the words in their path, told
apart by the word before. A token's occurrence
vector says how often each page of the host has it; tokens with equal vectors
form an equivalence class. A class that enough pages support is valid; it is
nested in the class its tokens' parents belong to, and the classes together are
the host's template. The places that hold text inside a template's tokens are
its slots; a slot is main text or not by the elements it is nested in and by
how much of its text on all of the host's pages is links. Extraction keeps the
text of main slots: those in a page's article, or, on a page without one, those
of few links. Each page is decided by itself, as a host may have several layouts.
Text whose words are mostly in one class that most of the host's pages share is the
template's own and left out of the slots, unless it is most of a page's main text:
such a page is a copy of others.

The vectors are never built: the exclusive or of a hash of page and count is the
same for tokens with the same vector, and it can be added up in parts. So a host
with a third of all pages is no different from others; each task sends one row
per host and token. Most words are on few pages and no template's, so a task
does not send the words on few of a host's pages it has read. What a task may
have left out is known as a number of pages, and words that could reach the
half of a host's pages with these are counted once more over the host's pages.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import map_batches, written

SUPPORT = 0.01  # of a host's pages that a template's token is on at least
LINKS = 0.35  # share of a slot's text that may be links
MOST = 0.5  # of a host's pages have a word that is template text; share of a block's words in one class that make it template text
LEAST_PAGES = 10  # fewer pages do not show what their host repeats
LEAST_CLASS = 3  # words of a valid class
COPY = 0.5  # share of a page's main text that may be template; a page that repeats more is a copy of others
HELD, HELD_PATHS = 2_000_000, 200_000  # words of pages, and paths, that a task adds up before it sends them
SENT_ROWS = 50_000  # that a task sends at once, and those of one host more
HELD_TAGS = 10_000  # that a task keeps
ALL_SENT, FEW = 4, 8  # of n pages of a host that are added up together, words on (n - ALL_SENT) / FEW at most are not sent
SMALL = 200_000  # rows of the template table that may be broadcast

# Kinds of HTML elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search "
                   "section summary table tbody td tfoot th thead title tr ul button select option label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form head title menu button select option dialog fieldset search".split())
# Class, id or role that names what is not the article; further words of such a name.
_NAMED = (r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|newsletter|popup|modal|side-?bar|navigation|"
          r"nav|nav-?bar|menu|breadcrumbs?|footer|site-?header|comments?|disqus|reply|replies|share|sharing|social|related|"
          r"recommend\w*|subscribe)")
_NOUN = (r"(?:9|area|articles|bar|block|box|buttons?|container|content|form|icons|inner|items?|links?|list|message|outer|posts?|"
         r"section|slot|text|unit|widget|wrapper)")
NAMES = re.compile(rf"(?:(?:site|page)[-_]+)?{_NAMED}(?:[-_]*(?:{_NAMED}|{_NOUN}))*")
UNNAMED = frozenset("html body main article".split())  # hold the article, whatever they are called
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|textarea)\b.*?(?:</\1\s*>|$)"
    r"|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|<[a-zA-Z/!?][^>]*(?:>|$)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=>/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)

MAIN, OTHER, ASIDE = 1, 0, -1
INNER = 2  # in an article within an element named as no part of it: main text of a page that has no other


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


def _label(name: str, tag: str) -> str:
    """An element as it stands in a path: name and attributes' words, digits made equal."""
    words = " ".join(v.strip("\"'") for v in _ATTRIBUTE.findall(tag)).lower()
    if _HIDDEN.search(tag):
        words += " hidden"
    return name + ("." + re.sub(r"[0-9]+", "9", ".".join(words.split())) if words.strip() else "")


def _tag(tag: str) -> tuple[str | None, bool, str]:
    """Element of a tag (None if it has none), whether it closes it, and its label if it opens a block."""
    name = _NAME.match(tag)
    if name is None:
        return None, False, ""
    element, closing = name.group(1).lower(), tag[1] == "/"
    return element, closing, _label(element, tag) if element in BLOCKS and element not in VOID and not closing else ""


class _Tags(dict):
    """What ``_tag`` says of tags; short ones repeat from page to page and are kept."""

    def __missing__(self, tag: str) -> tuple[str | None, bool, str]:
        found = _tag(tag)
        if len(tag) < 200:
            if len(self) > HELD_TAGS:
                self.clear()
            self[tag] = found
        return found


def blocks(page: str, tags: _Tags | None = None) -> Iterator[tuple[str, str, int]]:
    """(path, text, characters in links) of every block in page order; elements without text have an empty one.

    ``tags``: those of the pages before.
    """
    tags = _Tags() if tags is None else tags
    paths: list[str] = [""]  # of the open elements, from the page itself
    names: list[str] = []
    text: list[str] = []
    links = inside = 0

    for found in _TOKEN.finditer(page):
        token = found.group()
        if token[0] != "<" or token == "<":
            text.append(token)
            links += len(token) * inside
            continue
        if found.lastindex:  # elements whose content is no text
            continue
        element, closing, label = tags[token]
        if element is None:  # comments and declarations
            continue
        if element == "a":
            inside = 0 if closing else 1
        elif element == "br":
            text.append(" ")
        elif element in BLOCKS:
            if text:
                words = _plain(text)
                if words:
                    yield paths[-1], words, min(links, len(words))
                links = 0
            if not closing:
                if names and names[-1] == "p":  # a block ends an open paragraph
                    names.pop(), paths.pop()
                if element == "li" and "li" in names[-1:]:
                    names.pop(), paths.pop()
                if element not in VOID:
                    paths.append(f"{paths[-1]}/{label}" if names else label)
                    names.append(element)
                    yield paths[-1], "", 0
            elif element in names:
                at = len(names) - 1 - names[::-1].index(element)
                del names[at:], paths[at + 1:]
    words = _plain(text)
    if words:
        yield paths[-1], words, min(links, len(words))


def _plain(text: list[str]) -> str:
    """The collected text with character references decoded and white space made single spaces; clears the list."""
    words = " ".join(markup.unescape("".join(text)).split())
    text.clear()
    return words


def hint(path: str) -> int:
    """What the elements and names of a path say about text in it.

    A name counts as a whole word of class, id or role (``sidebar``, not ``has-sidebar``).
    """
    main = named = False
    for part in path.split("/"):
        name, _, words = part.partition(".")
        words = words.split(".")
        if name in SKIPPED or name == "header" and not main or "hidden" in words:
            return ASIDE
        own = name in ("article", "main") or "main" in words or "article" in words
        if name not in UNNAMED and not own and any(map(NAMES.fullmatch, words)):
            if main:
                return ASIDE
            named = True
        main = main or own
    return (INNER if main else ASIDE) if named else MAIN if main else OTHER


def _hashes(strings: list[str] | pa.Array) -> np.ndarray:
    """A hash for each string; strings that repeat are hashed once."""
    found = (pa.array(strings, pa.string()) if isinstance(strings, list) else strings).dictionary_encode()
    different = np.array(list(map(xxhash.xxh3_64_intdigest, found.dictionary.to_numpy(zero_copy_only=False))), np.uint64)
    return different[found.indices.to_numpy()]


def word_tokens(texts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of blocks (path, text) as tokens, one after the other, and how many each block has.

    A token is a word with its path and the word before it, which tells its roles apart.
    """
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = pc.split_pattern(pa.array([text for _, text in texts], pa.string()), " ")  # blocks have single spaces
    sizes = words.value_lengths().to_numpy().astype(np.int64)
    found = _hashes(words.flatten())
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[np.cumsum(sizes) - sizes] = 0
    paths = np.repeat(_mixed(_hashes([path for path, _ in texts])), sizes)
    return _mixed(_mixed(paths + before) + found).view(np.int64), sizes


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers (the last steps of splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _WordSums:
    """How many pages of a host have a token, and the fingerprint of how often, added up over some of the pages."""

    def __init__(self) -> None:
        self.pages: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, host: str, page: int, tokens: np.ndarray) -> None:
        """``page``: hash of the page."""
        tokens, times = np.unique(tokens, return_counts=True)
        self.pages.setdefault(host, []).append((tokens, _mixed(np.uint64(page) ^ _mixed(times.astype(np.uint64)))))
        self.held += len(tokens)

    def add_all(self, read: list[tuple[str, int, int]], texts: list[tuple[str, str]],
                wanted: Callable[[str, np.ndarray], np.ndarray] = lambda host, tokens: tokens) -> None:
        """``read``: host and hash of each page, and where its blocks end in ``texts``; ``wanted`` chooses among its tokens."""
        tokens, sizes = word_tokens(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])[[end for _, _, end in read]].tolist()
        start = 0
        for (host, page, _), end in zip(read, ends, strict=True):
            if end > start:
                self.add(host, page, wanted(host, tokens[start:end]))
            start = end

    def sent(self, dropped: Callable[[str], int]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """Columns host, token, pages and vector of the tokens on more than ``dropped(host)`` of their host's pages here."""
        hosts: list[str] = []
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for host, parts in self.pages.items():
            tokens = np.concatenate([t for t, _ in parts])
            if not len(tokens):
                continue
            order = np.argsort(tokens)
            tokens = tokens[order]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            pages = np.diff(starts, append=len(tokens))
            kept = pages > dropped(host)
            marks = np.concatenate([m for _, m in parts])[order]
            rows.append((tokens[starts[kept]], pages[kept], np.bitwise_xor.reduceat(marks, starts)[kept].view(np.int64)))
            hosts += [host] * len(rows[-1][0])
            if len(hosts) > SENT_ROWS:
                yield hosts, *map(np.concatenate, zip(*rows, strict=True))
                hosts, rows = [], []
        if hosts:
            yield hosts, *map(np.concatenate, zip(*rows, strict=True))
        self.pages.clear()
        self.held = 0


def _page_hash(key: int | None, url: str | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{key}:{url}")


def _tokens(pages: DataFrame) -> DataFrame:
    """(host, path, token, pages, vector, chars, links, hint, missed): structural tokens by path, words by token, of all pages.

    ``pages`` is how many pages have a token, ``vector`` the fingerprint of how often each has it. Words of one page
    are left out. A part of a host's pages sends no words that few of them have: at most ``missed`` pages of a part with
    a most frequent path on eight times as many and more. A row without path and token has the sum of these over all of
    a host's parts, a word's row that over the parts which sent it: a word's figures are whole if both are equal.
    """
    def run(batches) -> Iterable:
        sums: dict[tuple[str, str], list[int]] = {}
        found, tags = _WordSums(), _Tags()

        def sent() -> Iterator[list]:
            if sums:
                rows = [(h, p, 0, *v, hint(p), 0) for (h, p), v in sums.items()]
                yield list(map(list, zip(*rows, strict=True)))
            most: dict[str, int] = {}
            for (host, _), v in sums.items():
                most[host] = max(most.get(host, 0), v[0])
            few = {host: max(n - ALL_SENT, 0) // FEW for host, n in most.items()}
            if few:
                yield [list(few), *(pa.nulls(len(few), t) for t in (pa.string(), pa.int64())), *([0] * len(few) for _ in range(4)),
                       pa.nulls(len(few), pa.int32()), list(few.values())]
            for hosts, tokens, n_pages, vectors in found.sent(few.__getitem__):
                n = len(hosts)
                yield [hosts, pa.nulls(n, pa.string()), tokens, n_pages, vectors, *(np.zeros(n, np.int64) for _ in range(2)),
                       pa.nulls(n, pa.int32()), list(map(few.__getitem__, hosts))]
            sums.clear()

        for batch in batches:
            texts: list[tuple[str, str]] = []
            read: list[tuple[str, int, int]] = []
            for key, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                host, own = host_of(url), {}
                for path, text, links in blocks(page or "", tags):
                    entry = own.get(path)
                    if entry is None:
                        entry = own[path] = [0, 0, 0]
                    if text:
                        texts.append((path, text))
                        entry[1] += len(text)
                        entry[2] += links
                    else:
                        entry[0] += 1
                for path, (n, chars, links) in own.items():
                    place = sums.setdefault((host, path), [0, 0, 0, 0])
                    place[0] += 1
                    place[1] ^= int.from_bytes(xxhash.xxh3_64_digest(f"{key}:{url}:{n}"), "little", signed=True)
                    place[2] += chars
                    place[3] += links
                read.append((host, _page_hash(key, url), len(texts)))
            found.add_all(read, texts)
            if found.held > HELD or len(sums) > HELD_PATHS:
                yield from sent()
        yield from sent()

    parts = map_batches(pages.select("page_id", "url", "html"), run,
                        "host string, path string, token long, pages long, vector long, chars long, links long, hint int, missed long")
    return parts.groupBy("host", "path", "token").agg(
        F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"),
        F.sum("links").alias("links"), F.first("hint").alias("hint"), F.sum("missed").alias("missed")).where(
            F.col("path").isNotNull() | F.col("token").isNull() | (F.col("pages") > 1))


def _host() -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(
        "url", r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.lit("")))


def _counted(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """(host, token, pages, vector) of the words of ``asked`` (host, tokens), of all words of a host if ``tokens`` is null."""
    def run(batches) -> Iterable:
        found, tags = _WordSums(), _Tags()

        def sent() -> Iterator[list]:
            yield from map(list, found.sent(lambda host: 0))

        for batch in batches:
            texts: list[tuple[str, str]] = []
            read: list[tuple[str, int, int]] = []
            wanted: dict[str, np.ndarray | None] = {}
            for key, url, page, host, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                texts.extend((path, text) for path, text, _ in blocks(page or "", tags) if text)
                read.append((host, _page_hash(key, url), len(texts)))
                if host not in wanted:
                    wanted[host] = tokens.values.to_numpy() if tokens.is_valid else None
            found.add_all(read, texts, lambda host, tokens: tokens if wanted[host] is None else tokens[np.isin(tokens, wanted[host])])
            if found.held > HELD:
                yield from sent()
        yield from sent()

    placed = pages.select("page_id", "url", "html").withColumn("host", _host()).join(asked, "host")
    return map_batches(placed.select("page_id", "url", "html", "host", "tokens"), run,
                       "host string, token long, pages long, vector long").groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"))


def shared_words(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, token, pages, vector) of the words that most pages of their host share, from ``_tokens``.

    Words that not every part of a host's pages sent, but that may be on enough pages, are counted once more, and all words
    of a host whose parts may have sent such a word nowhere.
    """
    hosts = found.where("path IS NOT NULL").groupBy("host").agg(F.max("pages").alias("host_pages"))
    missed = found.where("path IS NULL AND token IS NULL").select("host", F.col("missed").alias("all_missed"))
    least = F.lit(MOST) * F.col("host_pages")
    hosts = written(hosts.where(F.col("host_pages") >= LEAST_PAGES).join(missed, "host").withColumn(
        "all_open", F.col("all_missed") + 1 >= least), "hosts")
    likely = written(found.where("path IS NULL AND token IS NOT NULL").select("host", "token", "pages", "vector", "missed")
                     .join(hosts.where(~F.col("all_open")), "host")
                     .where(F.col("pages") + F.col("all_missed") - F.col("missed") >= least)
                     .withColumn("whole", F.col("missed") == F.col("all_missed")), "likely-words")
    columns = ["host", "token", "pages", "vector"]
    shared = likely.where(F.col("whole") & (F.col("pages") >= least)).select(columns)
    asked = likely.where(~F.col("whole")).groupBy("host").agg(F.collect_list("token").alias("tokens")).unionByName(
        hosts.where("all_open").select("host", F.lit(None).cast("array<long>").alias("tokens")))
    if asked.isEmpty():
        return shared
    counted = _counted(pages, asked).join(hosts.select("host", "host_pages"), "host").where(F.col("pages") >= least)
    return shared.unionByName(counted.select(columns))


def repeated_words(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, token, class) of the words of valid classes that most pages of their host share; ``found``: from ``_tokens``."""
    shared = written(shared_words(pages, found), "shared-words")
    valid = shared.groupBy("host", "pages", "vector").count().where(F.col("count") >= LEAST_CLASS).drop("count")
    return shared.join(valid, ["host", "pages", "vector"]).select(
        "host", "token", F.xxhash64("pages", "vector").alias("class"))


def templates(pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(host, path, class, parent, pages, role) of every host's template.

    ``class`` numbers the equivalence class of a path's token within its host by
    its vector's fingerprint, ``parent`` is the class it is nested in. Paths on
    fewer than SUPPORT of the host's pages are in no valid class. ``found``: their
    tokens, if known.
    """
    found = _tokens(pages) if found is None else found
    tokens = found.where("path IS NOT NULL").drop("token")
    hosts = tokens.groupBy("host").agg(F.max("pages").alias("host_pages"))
    valid = written(tokens.join(hosts, "host").where(F.col("pages") >= F.greatest(F.lit(1), F.lit(SUPPORT) * F.col("host_pages"))),
                    "template-tokens")
    klass = F.xxhash64("pages", "vector")
    parents = valid.select("host", F.col("path").alias("above"), klass.alias("parent"))
    return (valid.withColumn("above", F.regexp_replace("path", "/?[^/]*$", ""))
            .join(parents, ["host", "above"], "left")
            .select("host", "path", klass.alias("class"), "parent", "pages",
                    F.when((F.col("hint") == OTHER) & (F.col("links") > F.lit(LINKS) * F.col("chars")), F.lit(ASIDE))
                    .otherwise(F.col("hint")).alias("role")))


def without_template(chosen: list[tuple[str, str]], repeated: tuple[np.ndarray, np.ndarray], tokens: np.ndarray,
                     sizes: np.ndarray) -> list[tuple[str, str]]:
    """The blocks (path, text) but for those whose words are mostly of one class of template text; all if little else is left.

    ``repeated``: tokens of template text in rising order, and numbers of their classes; ``tokens`` and ``sizes``: of the blocks.
    """
    known, classes = repeated
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    met = np.flatnonzero(known[at] == tokens)
    if not len(met):
        return chosen
    # How often each class occurs in each block.
    block = np.repeat(np.arange(len(sizes)), sizes)[met]
    pairs, times = np.unique(block * (int(classes.max()) + 1) + classes[at[met]], return_counts=True)
    most = np.zeros(len(sizes), np.int64)
    np.maximum.at(most, pairs // (int(classes.max()) + 1), times)
    own = [b for b, n, size in zip(chosen, most.tolist(), sizes.tolist(), strict=True) if n <= MOST * size]
    left, whole = (sum(len(text) for _, text in part) for part in (own, chosen))
    return own if left >= (1 - COPY) * whole else chosen


def _parsed(template: str | None, common: str | None) -> tuple[dict[str, int], tuple[np.ndarray, np.ndarray]]:
    """The roles of a host's paths, and its template text as ``without_template`` reads it."""
    lines = (line.rsplit("\t", 1) for line in (template or "").split("\n") if line)
    pairs = [x.split(":") for x in (common or "").split()]
    known = np.array([int(t) for t, _ in pairs], np.int64)
    classes = np.unique([c for _, c in pairs], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(known)
    return {path: int(role) for path, role in lines}, (known[order], classes[order])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Blocks have their character references decoded, white space made one space
    and trimmed, and are joined by line breaks in page order. A null or empty
    page, and one without main text, has the empty text. A page without a usable
    url belongs to the host ''. Repeated rows give repeated rows, an empty table
    gives none. Columns other than page_id, url and html are not read.
    """
    tokens = written(_tokens(pages), "page-tokens")
    found = written(templates(pages, tokens).select("host", "path", "role"), "templates")
    repeated = written(repeated_words(pages, tokens), "repeated-words")
    by_host = found.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(
        F.concat_ws("\t", "path", F.col("role").cast("string")))), "\n").alias("template"))
    by_host = by_host.join(repeated.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(
        F.concat_ws(":", "token", "class"))), " ").alias("words")),
                           "host", "left")
    side = F.broadcast(by_host) if found.count() + repeated.count() <= SMALL else by_host
    placed = (pages.select("page_id", "url", "html").withColumn("host", _host()).join(side, "host", "left")
              .select("page_id", "url", "html", "template", "words"))

    def run(batches) -> Iterable:
        parsed: dict[tuple, tuple[dict[str, int], tuple[np.ndarray, np.ndarray]]] = {}
        tags = _Tags()
        for batch in batches:
            main: list[list[tuple[str, str]]] = []
            asked: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []  # pages of hosts with template text
            for page, template, common in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if (template, common) not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[template, common] = _parsed(template, common)
                roles, repeated_here = parsed[template, common]
                kept: dict[int, list[tuple[str, str]]] = {MAIN: [], INNER: [], OTHER: [], ASIDE: []}
                for path, words, _ in blocks(page or "", tags):
                    if words:
                        role = roles.get(path)
                        kept[hint(path) if role is None else role].append((path, words))  # a rare path is no template slot
                # Has the page an article? If not, its dense slots elsewhere are the main text.
                main.append(kept[MAIN] or kept[INNER] or kept[OTHER])
                if len(repeated_here[0]) and main[-1]:
                    asked.append((len(main) - 1, repeated_here))
            tokens, sizes = word_tokens([block for at, _ in asked for block in main[at]])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            first = 0
            for at, repeated_here in asked:
                last = first + len(main[at])
                main[at] = without_template(main[at], repeated_here, tokens[bounds[first]:bounds[last]], sizes[first:last])
                first = last
            texts = ["\n".join(text for _, text in chosen) for chosen in main]
            yield [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    return map_batches(placed, run, "page_id long, url string, text string, n_chars long")
