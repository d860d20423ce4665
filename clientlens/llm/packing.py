"""Hierarchical multi-length packing of token sequences.

Every document's ids are cut into pieces that fill sequences. Whole windows of
the longest context are cut off first; the rest of a document is routed to the
smallest context size (tier) that holds it. Tiers are packed from long to
short: the rest of a document opens a window of its tier, the gap is filled
with whole rests from shorter tiers, largest first, and the last gap with the
head of a longer rest, so that windows are exactly full. What a task has left
when its input ends goes into sequences whose lengths are powers of two, so
nothing is padded.

Each task packs the documents it reads. There is no shuffle, no key that could
be hot, and memory holds one batch of documents and fewer than one window of
each tier.

Step groups: each sequence joins the first group of its task with room for it;
as all lengths are powers of two, every closed group holds exactly
``step_tokens`` tokens whatever mix of tiers it got.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import map_batches

CONTEXT = 2048
TIERS = (2048, 1024, 512, 256)
END_ID = 1
# Bytes that a task's remembered words may take (each with what Python needs for it) before it starts anew.
CACHED_BYTES = 48 << 20
_ENTRY_BYTES = 220

# Fixed value: the word pattern of the byte-level BPE file, for words that white space of one character parts. The file has
# \s+(?!\S)|\s+ where this has \s, which is the same for these, and looks ahead for nothing.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def _byte_spelling() -> dict[str, int]:
    """The file spells bytes as characters: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _fast_words(path: str):
    """An encoder of words by the same ranks and the bytes of each id, or None if the file's ids are not in the order of its merges."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, bytes_of = model["vocab"], _byte_spelling()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary["".join(m)] for m in merges]
    if made != sorted(made):
        return None
    pieces = {c: i for c, i in vocabulary.items() if len(c) == 1} | dict(zip(("".join(m) for m in merges), made, strict=True))
    ranks = {bytes(bytes_of[c] for c in piece): i for piece, i in pieces.items()}
    widths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    widths[list(ranks.values())] = list(map(len, ranks))
    return tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, widths


class WordTokens:
    """Ids of texts by a byte-level BPE file of ``tokenizers``, with remembered words.

    The file's word pattern starts a new word at every single space, and a
    single line break is a word of its own. A text whose white space consists
    only of such single characters is therefore encoded as the sequence of its
    space-separated parts, and equal parts have equal ids. Other texts, and
    texts with characters outside the Latin blocks, go to the library whole.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.other = re.compile("[^\n\x20-\x7e¡-ɏ‐-‧]")
        self.ids: dict[str, bytes] = {}
        self.cached = 0
        self.fast, self.widths = _fast_words(path) or (None, None)
        # A text that is not encoded by its words.
        self.unsplit = "|".join((r"[^\n\x20-\x7e¡-ɏ‐-‧]", r"[ \n]{2}", r"\A[ \n]", r"[ \n]\z",
                                 *(rf"\Q{t}\E" for t in self.special)))

    def _remember(self, words: list[str]) -> None:
        if self.fast is not None:
            found = map(self.fast, words)
        else:
            found = (e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False))
        for word, ids in zip(words, found, strict=True):
            self.ids[word] = data = array("I", ids).tobytes()
            self.cached += _ENTRY_BYTES + len(word) + len(data)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        plain: list[list[str] | None] = []
        for text in texts:
            if not text:
                plain.append([])
            elif (self.other.search(text) or text[0] in " \n" or text[-1] in " \n"
                  or any(s in text for s in ("  ", "\n\n", " \n", "\n ", *self.special))):
                plain.append(None)
            else:
                # A line's first part has no space before it, the others have one.
                plain.append(text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))
        if self.cached > CACHED_BYTES:
            self.ids.clear()
            self.cached = 0
        self._remember(list(set().union(*(p for p in plain if p)).difference(self.ids)))
        get = self.ids.__getitem__
        return [array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() if parts is None
                else b"".join(map(get, parts)) for text, parts in zip(texts, plain, strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has.

        Where ``encode_all`` remembers words one by one, this finds the different
        words of the column and encodes each once; nothing is remembered.
        """
        texts = texts.cast(pa.large_string())
        plain = pc.invert(pc.match_substring_regex(texts, self.unsplit))
        ids, lengths = self._by_words(texts.filter(plain))
        plain = plain.to_numpy(zero_copy_only=False)
        if plain.all():
            return ids, lengths
        parts = iter(np.split(ids, np.cumsum(lengths)))
        whole = [next(parts) if by_words else np.array(self.library.encode(text.as_py(), add_special_tokens=False).ids, np.uint32)
                 for text, by_words in zip(texts, plain.tolist(), strict=True)]
        return np.concatenate(whole), np.array(list(map(len, whole)), np.int64)

    def _by_words(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """``encode_column`` of texts whose words are encoded one by one."""
        bounds, data = _content(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # A word starts at a white space, after a line break and with a text.
        opens = (data == 0x20) | (data == 0x0A)
        opens[1:] |= data[:-1] == 0x0A
        opens[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(opens)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        numbers = words.indices.to_numpy()
        ids, first, counts = self._different_words(words.dictionary)
        ends = np.cumsum(counts[numbers])
        found = np.empty(int(ends[-1]), np.uint32)
        for at in range(0, len(numbers), 1 << 19):
            part = numbers[at:at + (1 << 19)]
            base = int(ends[at - 1]) if at else 0
            n = counts[part]
            last = np.cumsum(n)
            found[base:base + int(last[-1])] = ids[np.repeat(first[part] - last + n, n) + np.arange(last[-1])]
        return found, np.diff(np.append(0, ends)[np.searchsorted(starts, bounds)])

    def _different_words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each word the place of its first one and how many it has."""
        bounds, data = _content(words)
        if self.fast is None:
            found = [e.ids for e in self.library.encode_batch_fast([w.decode() for w in words.to_pylist()], add_special_tokens=False)]
            counts = np.array(list(map(len, found)), np.int64)
            return np.array([i for ids in found for i in ids], np.uint32), np.cumsum(counts) - counts, counts
        # One text of all words: a line break, whose id is left out, goes before those that start with no white space.
        opening = data[bounds[:-1]]
        bare = (opening != 0x20) & (opening != 0x0A)
        text = np.insert(data, bounds[:-1][bare], 0x0A).tobytes().decode()
        ids = np.array(self.fast(text), np.uint32)
        places = np.append(0, np.cumsum(self.widths[ids]))
        start = bounds[:-1] + np.cumsum(bare)
        end = start + np.diff(bounds)
        first, last = np.searchsorted(places, start), np.searchsorted(places, end)
        assert (places[first] == start).all() and (places[last] == end).all()
        return ids, first, last - first


def _content(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of the values of a large string or binary array."""
    _, bounds, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    bounds = np.frombuffer(bounds, np.int64, len(texts) + 1, 8 * texts.offset)
    return bounds - bounds[0], np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]


class TierPacker:
    """Packs one task's pieces; ``out`` receives (sequence, tier, pieces).

    A piece is (document, start, length, ids as bytes, tokens of the document).
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers) or sorted(tiers, reverse=True) != list(tiers):
            raise ValueError("tiers must be falling powers of two")
        self.tiers = tiers
        self.waiting: dict[int, deque] = {t: deque() for t in tiers}

    def _route(self, piece: tuple) -> None:
        tier = min(t for t in self.tiers if t >= piece[2])
        self.waiting[tier].append(piece)

    def add(self, document, ids: bytes) -> Iterator[tuple[int, list[tuple]]]:
        """Take a document; yields its whole windows."""
        longest, tokens = self.tiers[0], len(ids) // 4
        start = 0
        while tokens - start >= longest:
            yield longest, [(document, start, longest, ids[4 * start:4 * (start + longest)], tokens)]
            start += longest
        if start < tokens:
            self._route((document, start, tokens - start, ids[4 * start:], tokens))

    def _cut(self, piece: tuple, length: int) -> tuple:
        """The head of ``piece``; the rest is routed again."""
        document, start, total, ids, tokens = piece
        if total > length:
            self._route((document, start + length, total - length, ids[4 * length:], tokens))
        return document, start, min(length, total), ids[:4 * length], tokens

    def _fill(self, window: list[tuple], gap: int) -> int:
        """Fill the gap with whole rests of tiers that fit, then with the head of a longer one."""
        while gap:
            fitting = next((t for t in self.tiers if t <= gap and self.waiting[t]), None)
            longer = next((t for t in reversed(self.tiers) if t > gap and self.waiting[t]), None)
            if fitting is not None:
                piece = self.waiting[fitting].popleft()
            elif longer is not None:
                piece = self._cut(self.waiting[longer].popleft(), gap)
            else:
                break
            window.append(piece)
            gap -= piece[2]
        return gap

    def windows(self) -> Iterator[tuple[int, list[tuple]]]:
        """Full windows of every tier, long tiers first; what can't fill one keeps waiting."""
        left = sum(p[2] for queue in self.waiting.values() for p in queue)
        for tier in self.tiers:
            while self.waiting[tier] and left >= tier:
                window = [self.waiting[tier].popleft()]
                gap = self._fill(window, tier - window[0][2])
                assert not gap
                left -= tier
                yield tier, window

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        """All that waits, in sequences of falling powers of two."""
        yield from self.windows()
        left = sum(p[2] for queue in self.waiting.values() for p in queue)
        size = self.tiers[0]
        while left:
            while size > left:
                size //= 2
            window: list[tuple] = []
            self._fill(window, size)
            left -= size
            yield size, window


def pack(docs: DataFrame, tokenizer: str, context: int = CONTEXT, tiers: tuple[int, ...] = TIERS,
         step_tokens: int = 16 * CONTEXT, end_id: int = END_ID, ids: str = "array") -> DataFrame:
    """Pieces of all documents in sequences of at most ``context`` tokens.

    Columns: doc_id, start, length, doc_tokens, sequence_id, offset,
    sequence_tokens, step_group, and the piece's ids as an array (``ids="array"``)
    or their crc32 (``ids="crc32"``, column ids_crc32).

    A null or empty text is one piece with the end id. A null doc_id stays null.
    Repeated rows are packed as often as they occur. An empty table gives no
    rows. Columns other than doc_id and text are not read.
    """
    if tiers[0] != context:
        raise ValueError("the longest tier is the context size")
    checksum = ids == "crc32"
    last, ids_type = ("ids_crc32", "long") if checksum else ("ids", "array<int>")
    ending = array("I", [end_id]).tobytes()

    def run(batches) -> Iterable:
        words, packer = WordTokens(tokenizer), TierPacker(tiers)
        base = TaskContext.get().partitionId() << 36
        counts = {"sequence": 0, "group": 0}
        rooms: dict[int, int] = {}
        rows: list[list] = [[] for _ in range(9)]

        def place(tier: int, window: list[tuple]) -> None:
            group = next((g for g, room in rooms.items() if room >= tier), None)
            if group is None:
                group = counts["group"]
                counts["group"] += 1
                rooms[group] = step_tokens
            rooms[group] -= tier
            if not rooms[group]:
                del rooms[group]
            offset = 0
            for document, start, length, data, tokens in window:
                value = zlib.crc32(data) if checksum else data
                for column, cell in zip(rows, (document, start, length, tokens, base + counts["sequence"], offset,
                                               tier, base + group, value), strict=True):
                    column.append(cell)
                offset += length
            counts["sequence"] += 1

        def taken() -> list[list]:
            nonlocal rows
            done, rows = rows, [[] for _ in range(9)]
            if not checksum:
                done[-1] = pa.ListArray.from_arrays(
                    np.cumsum([0, *done[2]], dtype=np.int32), np.frombuffer(b"".join(done[-1]), np.int32))
            return done

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 512):
                encoded = words.encode_all(texts[at:at + 512])
                for key, data in zip(keys[at:at + 512], encoded, strict=True):
                    for tier, window in packer.add(key, data + ending):
                        place(tier, window)
                for tier, window in packer.windows():
                    place(tier, window)
                yield taken()
        for tier, window in packer.rest():
            place(tier, window)
        yield taken()

    return map_batches(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run,
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
        f"sequence_tokens long, step_group long, {last} {ids_type}")
