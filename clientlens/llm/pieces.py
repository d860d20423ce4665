"""SentencePiece-style BPE by a merge-type prefix table.

For a BPE vocabulary in which a merge's priority belongs to the merged piece,
the encoding of a text determines the encoding of each of its prefixes up to
its last token, and that last token is unique: it is the one piece that ends at
the prefix's end and is compatible with the last token of what stands before
it. So one pass stores the last token of every prefix: an automaton gives the
pieces that end at each place, and the pair test decides which of them is
right. The ids are then read backwards from the end.

Two pieces are compatible if encoding their concatenation gives just these two.
The test undoes merges at the common edge, latest first, and looks whether a
merge across the edge would have come earlier.

Pieces of several spaces share one lowest priority, so they are merged last and
from the left; runs of bare spaces are therefore put together after the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import map_batches

SPACE = "▁"
CACHED_WORDS = 500_000


class PieceCodec:
    """Encoder and decoder for a BPE model file with byte fallback, a leading space and no normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.bytes: dict[int, int] = {}
        pieces: dict[str, int] = {}
        self.text: list[bytes] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text.append(b"")
            else:
                pieces[piece] = i
                self.text.append(piece.replace(SPACE, " ").encode())
        self.space_runs = {len(p): i for p, i in pieces.items() if len(p) > 1 and not p.strip(SPACE)}
        self.space_runs[1] = pieces[SPACE]
        self.run_lengths = sorted(self.space_runs, reverse=True)
        usual = [p for p in pieces if len(p) == 1 or p.strip(SPACE)]
        if any(SPACE in p[1:] for p in usual):
            raise ValueError("a piece holds a space after another character")
        # Rank: single characters first, then by falling score.
        usual.sort(key=lambda p: (len(p) > 1, -model.get_score(pieces[p])))
        self.ids = [pieces[p] for p in usual]
        self.length = [len(p) for p in usual]
        self.rank_of: dict[str, int] = {}
        self.halves: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        self._compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for rank, piece in enumerate(usual):
            halves = (rank, rank) if len(piece) == 1 else self._halves(piece)
            self.halves.append(halves or (rank, rank))
            if halves is None:  # no sequence of merges makes this piece
                continue
            if len(piece) > 1:
                self.merged[halves] = rank
            self.rank_of[piece] = rank
            self.automaton.add_word(piece, rank)
        self.automaton.make_automaton()
        self.breaks = "\n" not in pieces
        self.after_space = _Cache(lambda part: tuple(self._table(SPACE + part)))
        self.bare = _Cache(lambda part: tuple(self._table(part)))
        self.one_space = pieces[SPACE]

    def _halves(self, piece: str) -> tuple[int, int] | None:
        """The last merge of a piece: the split whose halves are compatible."""
        for at in range(len(piece) - 1, 0, -1):
            left, right = self.rank_of.get(piece[:at]), self.rank_of.get(piece[at:])
            if left is not None and right is not None and self.compatible(left, right):
                return left, right
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the edge of two neighbours would come before the merges that made them."""
        key = (left, right)
        known = self._compatible.get(key)
        if known is not None:
            return known
        limit = len(self.length)  # merges across the edge must come no earlier than this rank
        answer = True
        while True:
            if self.merged.get((left, right), limit) < limit:
                answer = False
                break
            # Undo the later merge; at equal rank the left one came first.
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        break
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        break
        if len(self._compatible) < 2_000_000 and len(self.halves) == len(self.length):
            self._compatible[key] = answer
        return answer

    def _table(self, text: str) -> list[int]:
        """Ids of a text whose spaces are single and leading."""
        if not text:
            return []
        # Last token of each prefix as a rank; -1: the prefix ends in a character without a piece.
        last = [-1] * len(text)
        length, compatible = self.length, self.compatible
        decided = -1
        for end, rank in self.automaton.iter(text):
            if end == decided:
                continue
            before = end - length[rank]
            if before < 0 or last[before] < 0 or compatible(last[before], rank):
                last[end] = rank
                decided = end
        ids: list[int] = []
        at = len(text) - 1
        while at >= 0:
            rank = last[at]
            if rank < 0:
                ids.extend(self.bytes[b] for b in reversed(text[at].encode()))
                at -= 1
            else:
                ids.append(self.ids[rank])
                at -= length[rank]
        ids.reverse()
        return ids

    def _joined_spaces(self, ids: list[int]) -> list[int]:
        """Merge runs of bare spaces. At equal priority they double up from the left, which leaves the longest
        piece that fits, again and again."""
        out: list[int] = []
        at = 0
        while at < len(ids):
            end = at
            while end < len(ids) and ids[end] == self.one_space:
                end += 1
            if end - at < 2:
                out.append(ids[at])
                at += 1
                continue
            left = end - at
            while left:
                longest = next(n for n in self.run_lengths if n <= left)
                out.append(self.space_runs[longest])
                left -= longest
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if not text:
            return []
        spaced = text.replace(SPACE, " ")
        ids: list[int] = []
        lines = spaced.split("\n") if self.breaks else [spaced]
        broken = [self.bytes[10]] if self.breaks else []
        word, first = self.after_space, self.after_space
        for number, line in enumerate(lines):
            if number:
                ids += broken
                first = self.bare
            parts = line.split(" ")
            ids += first[parts[0]]
            for part in parts[1:]:
                ids += word[part]
        return self._joined_spaces(ids) if "  " in spaced or spaced[0] == " " else ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: bytes that are no UTF-8 become replacement characters, the leading space goes."""
        data = b"".join(map(self.text.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class _Cache(dict):
    """Results of a function by word, forgotten when there are too many."""

    def __init__(self, function: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.function = function

    def __missing__(self, part: str) -> tuple[int, ...]:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[part] = found = self.function(part)
        return found


def encode_decode(docs: DataFrame, model: str, derive: Callable[[list[int], str], tuple] | None = None,
                  derived: str = "") -> DataFrame:
    """Ids and decoded text of every document's whole text: doc_id, ids, decoded.

    ``derive`` turns (ids, decoded) into the columns named in ``derived`` inside
    the task instead, for callers that need only a digest of them.

    Null and empty texts have no ids and decode to the empty text. A null doc_id
    stays null, repeated rows give repeated rows, an empty table gives none.
    Columns other than doc_id and text are not read.
    """
    finish = derive or (lambda ids, text: (ids, text))

    def run(batches) -> Iterable:
        codec = PieceCodec(model)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 256):
                rows = []
                for text in texts.slice(at, 256).to_pylist():
                    ids = codec.encode(text)
                    rows.append(finish(ids, codec.decode(ids)))
                yield [keys[at:at + 256], *map(list, zip(*rows, strict=True))]

    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run,
                       "doc_id long, " + (derived or "ids array<int>, decoded string"))
