"""Exact n-gram Jaccard join by a token-group matrix.

A document is the set of hashes of its distinct five-word shingles ("tokens").
Similar sets are put into groups; the matrix holds, for each token, the groups
in whose union it occurs. A set q can only be similar to a set outside its own
group if the unions of other groups hold 80 of 100 of q's tokens; for one group
g the overlap of q with the union of g bounds the overlap with every member of
g. Only groups whose bound qualifies are opened and compared set by set.

Steps:

1. One pass over the texts gives id, set (by hash) and, as the sample, a quarter
   of the set's tokens and two more: those with the lowest hashes. Each set is
   first its own group; copies are one set. If a similar set exists, at most a
   fifth of q's tokens are missing in it, so ``quarter + 1 - fifth`` tokens of
   the sample must occur in its sample. Sets below this bound are done: they
   have no link. The second token more makes up for the similar set's sample,
   which may be cut off earlier if that set has other tokens.
2. The rest are read again in full. Sets that share the smallest of their
   rehashed tokens are walked, those with most tokens found elsewhere first, and
   compared with the leaders of their bucket; links to leaders join them into groups. Large buckets are split by a
   hash, and their sets meet again in a second walk with other buckets.
3. The matrix of all tokens of these sets gives for each token the number of
   groups that have it. Tokens of one group only bound q from outside: if other
   groups lack more than a fifth of q's tokens, q is done.
4. For the others, tokens are ordered by their number of groups. Of the first
   fifth and one more in this order, q shares at least one with any similar set,
   and so does that set: a group without one of them cannot qualify. The members
   of qualifying groups that have such a token, and a size and a number of tokens
   found elsewhere that fit, are compared with q. Members of q's own group are
   not: they are joined already. Each q first meets, per token, the set with the
   largest share of tokens found elsewhere, which is the centre of a family of
   copies; the links found so join groups before the rest is compared. The rest
   meets with signatures: each token flips one of 256 bits, so that two sets
   whose signatures differ in d bits differ in d tokens at least. Documents that
   share a common passage and nothing else are told apart by this alone.

Every step is exact, so the result has every link that the definition gives.
No step builds pairs within a group, and no list per key is held: the walks
stream over sorted rows and hold a bounded number of leaders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import map_batches, written
from clientlens.llm.graphs import components

WORDS = 5
SIMILARITY = 80  # per cent
LEADERS = 16  # compared with by each set of a bucket
BUCKET = 20_000  # sets of a bucket that are walked together
HELD = 1_000_000  # rows of one key that a task holds
BATCH_TOKENS = 400_000  # of the samples that a task compares before it sends them
SMALL = 1_000_000  # rows of a table of ids that may be broadcast
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                    0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
SIGNATURE = tuple(f"signature{i}" for i in range(4))
SINGLE, SHARED, COUNT, DOCUMENT = range(4)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles; of the whole sequence if it is shorter; else nothing."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64).view(np.int64)
    digest = xxhash.xxh3_64_intdigest
    hashed = np.array([digest(w) for w in words], np.uint64)
    n = len(hashed) - WORDS + 1
    mixed = hashed[:n] * _ODD[0]
    for k in range(1, WORDS):
        mixed = mixed + _mix(hashed[k:n + k] * _ODD[k] + np.uint64(k))
    return np.unique(_mix(mixed).view(np.int64))


def set_id(tokens: np.ndarray) -> int:
    """One number for equal sets."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def sample_size(n):
    """One more than ``_needed`` counts on: a partner's sample may end one shared token earlier."""
    return n // 4 + 2


def signature(tokens: np.ndarray) -> list[int]:
    """256 bits as four longs; every token flips the bit that its hash names."""
    bit = (_mix(tokens.view(np.uint64) ^ _ODD[4]) & np.uint64(255)).astype(np.int64)
    flipped = np.bincount(bit, minlength=256) & 1
    return np.packbits(flipped.astype(np.uint8)).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < SIMILARITY * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= SIMILARITY * (len(a) + len(b) - shared)


def _send_samples(batches) -> Iterator[list]:
    """Rows of (key, set, n, kind) from (doc_id, text).

    DOCUMENT rows carry the id and the size of its set. Tokens that several sets
    of this task share are settled here: one SHARED row per token tells other
    tasks, COUNT rows tell the sets. Only tokens of one set travel with it.
    """
    ids, sizes, sets, samples = [], [], [], []
    held = 0

    def sent() -> list:
        # Copies within the task are one set.
        once = np.unique(np.array(sets, np.int64), return_index=True)[1]
        tokens = np.concatenate([samples[i] for i in once])
        owner = np.repeat(np.array(sets, np.int64)[once], [len(samples[i]) for i in once])
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        starts = np.r_[True, tokens[1:] != tokens[:-1]][:len(tokens)]
        at = np.flatnonzero(starts)
        several = owner[at] != owner[np.r_[at[1:], len(tokens)][:len(at)] - 1]
        shared = np.repeat(several, np.diff(np.r_[at, len(tokens)]))
        alone, known = ~shared, shared & starts
        own, counts = np.unique(owner[shared], return_counts=True)
        key = np.concatenate([tokens[alone], tokens[known], own, np.array(ids, np.int64)])
        of = np.concatenate([owner[alone], np.zeros(known.sum(), np.int64), own, np.array(sets, np.int64)])
        n = np.concatenate([np.zeros(alone.sum() + known.sum(), np.int64), counts, np.array(sizes, np.int64)])
        kind = np.repeat(np.array([SINGLE, SHARED, COUNT, DOCUMENT], np.int8),
                         [alone.sum(), known.sum(), len(own), len(ids)])
        for part in (ids, sizes, sets, samples):
            part.clear()
        return [key, of, n.astype(np.int32), kind]

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for at in range(0, len(keys), 256):
            for key, text in zip(keys[at:at + 256], batch.column(1).slice(at, 256).to_pylist(), strict=True):
                tokens = shingle_set(text)
                ids.append(key)
                sizes.append(len(tokens))
                sets.append(set_id(tokens))
                samples.append(tokens[:sample_size(len(tokens))] >> 20 if len(tokens) else tokens)
                held += len(samples[-1])
            if held > BATCH_TOKENS:
                held = 0
                yield sent()
    if ids:
        yield sent()


def _count_shared(batches) -> Iterator[list]:
    """From rows sorted by key: DOCUMENT and COUNT rows, and a COUNT for every set whose token another set has too."""
    carried = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int8)]

    def settled(key, of, n, kind) -> list:
        passed = kind >= COUNT
        token, owner, mark = key[~passed], of[~passed], kind[~passed]
        if len(token):
            order = np.lexsort((owner, mark, token))
            token, owner, mark = token[order], owner[order], mark[order]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[starts, len(token)])
            low, high = np.minimum.reduceat(owner, starts), np.maximum.reduceat(owner, starts)
            found = (low != high) | (np.maximum.reduceat(mark, starts) == SHARED)
            own, counts = np.unique(owner[np.repeat(found, sizes) & (mark == SINGLE)], return_counts=True)
        else:
            own, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        return [np.concatenate([key[passed], own]), np.concatenate([of[passed], own]),
                np.concatenate([n[passed], counts.astype(np.int32)]),
                np.concatenate([kind[passed], np.full(len(own), COUNT, np.int8)])]

    for batch in batches:
        rows = [np.concatenate([c, batch.column(i).to_numpy(zero_copy_only=False)]) for i, c in enumerate(carried)]
        if not len(rows[0]):
            continue
        last = np.searchsorted(rows[0], rows[0][-1])  # the last key may go on in the next batch
        carried = [r[last:] for r in rows]
        if len(carried[0]) > 1_000_000:  # a token of very many sets: two owners and the mark say all
            done = settled(*carried)
            yield done
            keep = carried[0][:1]
            carried = [keep, np.zeros(1, np.int64), np.zeros(1, np.int32), np.full(1, SHARED, np.int8)]
        yield settled(*(r[:last] for r in rows))
    if len(carried[0]):
        yield settled(*carried)


def _walk(batches) -> Iterator[list]:
    """Links of sets to leaders, from rows (bucket, part, set, tokens) sorted by bucket and part."""
    place, leaders = None, []
    for batch in batches:
        buckets, parts, sets = (batch.column(i).to_pylist() for i in range(3))
        column = batch.column(3)
        found: tuple[list, list] = ([], [])
        for i, (bucket, part, own) in enumerate(zip(buckets, parts, sets, strict=True)):
            if (bucket, part) != place:
                place, leaders = (bucket, part), []
            tokens = column[i].values.to_numpy()
            for leader, theirs in leaders:
                if similar(tokens, theirs):
                    found[0].append(own)
                    found[1].append(leader)
                    break
            else:
                if len(leaders) < LEADERS:
                    leaders.append((own, tokens.copy()))
        yield list(found)


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _leader_links(sets: DataFrame) -> DataFrame:
    """Links of sets to leaders of their bucket.

    Buckets above BUCKET sets are split by a hash; their sets are walked once more in other buckets.
    """
    large = written(sets.groupBy("bucket0").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("parts")).where("parts > 1"), "buckets")
    rows = large.count()
    sized = sets.join(_maybe_broadcast(large, rows), "bucket0", "left")
    walks = []
    for bucket in ("bucket0", "bucket1") if rows else ("bucket0",):
        part = F.pmod(F.xxhash64("set", F.lit(bucket)), F.coalesce("parts", F.lit(1)))
        placed = (sized if bucket == "bucket0" else sized.where("parts IS NOT NULL")).select(
            F.col(bucket).alias("bucket"), part.alias("part"), "set", "tokens", "share")
        walks.append(map_batches(placed.repartition("bucket", "part").sortWithinPartitions(
            "bucket", "part", F.desc("share"), "set"), _walk, "a long, b long"))
    return walks[0].union(walks[1]) if rows else walks[0]


def _needed(shared: Column, n: Column) -> Column:
    """Whether so many of the sample's tokens occur elsewhere that a partner is possible."""
    return (shared > 0) & (shared >= F.floor(n / 4) + 1 - F.floor(n / 5))


def _send_tokens(batches) -> Iterator[list]:
    """(token, set's number, group, n) of every token; the token is cut to 44 bits, which can only add candidates."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            sizes = batch.column(2).to_numpy()
            yield [batch.column(3).flatten().to_numpy() >> 20, np.repeat(batch.column(0).to_numpy(), sizes),
                   np.repeat(batch.column(1).to_numpy(), sizes), np.repeat(sizes, sizes)]


def _groups_of(columns: list[np.ndarray]) -> np.ndarray:
    """For rows sorted by the first column: in how many groups (third column) its value occurs."""
    token, group = columns[0], columns[2]
    order = np.lexsort((group, token))
    starts = np.r_[True, token[1:] != token[:-1]]
    placed = group[order]
    fresh = starts | np.r_[True, placed[1:] != placed[:-1]]
    at = np.flatnonzero(starts)
    return np.repeat(np.add.reduceat(fresh.astype(np.int64), at), np.diff(np.r_[at, len(token)]))


def _carry(batches, width: int, settle: Callable[[list[np.ndarray]], list],
           endless: Callable[[list[np.ndarray]], list] | None = None) -> Iterator[list]:
    """Give ``settle`` the rows of whole keys, from rows sorted by key.

    ``endless``, if given, settles parts of a key that has more than HELD rows, so that no key is held whole.
    """
    held: list[np.ndarray] | None = None
    going = None  # a key that is settled in parts
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
        if going is not None:
            end = np.searchsorted(rows[0], going, side="right")
            if end:
                yield endless([r[:end] for r in rows])
                rows = [r[end:] for r in rows]
            if len(rows[0]):
                going = None
            else:
                held = None
                continue
        last = np.searchsorted(rows[0], rows[0][-1])
        if last:
            yield settle([r[:last] for r in rows])
        held = [r[last:] for r in rows]
        if endless and len(held[0]) > HELD:
            going = held[0][0]
            yield endless(held)
            held = None
    if held is not None and len(held[0]):
        yield settle(held)


def _shared_tokens(batches) -> Iterator[list]:
    """(set's number, token, groups, n, group) of tokens that occur in two groups or more."""
    def settle(columns: list[np.ndarray]) -> list:
        groups = _groups_of(columns)
        kept = groups > 1
        token, number, group, n = (c[kept] for c in columns)
        return [number, token, groups[kept], n, group]

    def endless(columns: list[np.ndarray]) -> list:  # the most frequent tokens come last, in whatever number of groups
        token, number, group, n = columns
        return [number, token, np.full(len(token), HELD), n, group]

    return _carry(batches, 4, settle, endless)


def _leading(batches) -> Iterator[list]:
    """(token, set's number, group, n, shared, first): of each set that may have a partner, the tokens that name one.

    ``first`` marks those of which one must be common with every similar set that is not smaller.
    """
    def settle(columns: list[np.ndarray]) -> list:
        number, token, groups, n, group = columns
        at = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        order = np.lexsort((token, groups, number))
        count = np.diff(np.r_[at, len(number)])
        place = np.arange(len(number)) - np.repeat(at, count)
        shared = np.repeat(count, count)
        # Tokens of q's own group alone stand first in the order and name nobody.
        kept = (100 * shared >= SIMILARITY * n) & (place < n // 5 + 1 - (n - shared))
        rows = order[kept]
        first = place < n // 9 + 1 - (n - shared)
        return [token[rows], number[rows], group[rows], n[rows], shared[rows], first[kept]]

    return _carry(batches, 5, settle)  # a key is one document


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the pairs of numbers: the tokens of both are brought together and counted."""
    pairs = written(pairs, "pairs")
    named = pairs.select(F.col("number_a").alias("number")).union(pairs.select(F.col("number_b").alias("number"))).distinct()
    named = written(named, "named")
    wanted = sets.join(_maybe_broadcast(named, named.count()), "number", "left_semi").select("number", "set", "tokens")
    left = wanted.select(F.col("number").alias("number_a"), F.col("set").alias("a"), F.col("tokens").alias("mine"))
    right = wanted.select(F.col("number").alias("number_b"), F.col("set").alias("b"), F.col("tokens").alias("theirs"))
    met = pairs.join(left, "number_a").join(right, "number_b").select("a", "b", "mine", "theirs")

    def compare(batches) -> Iterable:
        for batch in batches:
            hits = [similar(batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy())
                    for i in range(batch.num_rows)]
            yield [[v for v, hit in zip(batch.column(c).to_pylist(), hits, strict=True) if hit] for c in (0, 1)]

    return written(map_batches(met, compare, "a long, b long"), "opened")


def _fits() -> Column:
    """Whether two sets of different groups can be similar by their sizes and their numbers of shared tokens."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return ((F.col("group_a") != F.col("group_b")) & (n_a * 100 >= n_b * SIMILARITY) & (n_b * 100 >= n_a * SIMILARITY)
            & (F.least("shared_a", "shared_b") * (100 + SIMILARITY) >= (n_a + n_b) * SIMILARITY))


def _near_signatures() -> Column:
    """Whether two sets can be similar by their signatures: of similar ones, a ninth of all tokens at most is in one alone."""
    differing = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SIGNATURE), F.lit(0))
    return differing * (100 + SIMILARITY) <= (F.col("n_a") + F.col("n_b")) * (100 - SIMILARITY)


def _open_groups(sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """Links of sets with members of other groups.

    sets: number, set, n, tokens, SIGNATURE; grouped: set, root. Sets without a root are their own group.
    """
    owned = (sets.join(_maybe_broadcast(grouped, grouped.count()), "set", "left")
             .select("number", F.coalesce("root", "set").alias("group"), "n", "tokens"))
    by_token = map_batches(owned, _send_tokens, "token long, number long, group long, n int").repartition(
        "token").sortWithinPartitions("token")
    shared = map_batches(by_token, _shared_tokens, "number long, token long, groups long, n int, group long")
    leading = written(map_batches(shared.repartition("number").sortWithinPartitions("number"), _leading,
                                  "token long, number long, group long, n int, shared long, first boolean"), "leading")

    def side(rows: DataFrame, name: str, more: tuple = ()) -> DataFrame:
        return rows.select("token", *(F.col(c).alias(f"{c}_{name}") for c in ("number", "group", "n", "shared", *more)))

    centre = leading.groupBy("token").agg(F.max(F.struct(
        (F.col("shared") / F.col("n")).alias("share"), "number", "group", "n", "shared")).alias("c")).select("token", "c.*")
    near = (side(leading, "a").join(side(centre, "b"), "token").where(_fits())
            .select("number_a", "number_b").distinct())
    first = _compared(near, sets)
    roots = written(components(first.union(grouped.select(F.col("set").alias("a"), F.col("root").alias("b")))), "groups")
    moved = (leading.join(_maybe_broadcast(roots, roots.count()), F.col("group") == F.col("a"), "left")
             .select("token", "number", F.coalesce("root", "group").alias("group"), "n", "shared", "first"))
    several = (moved.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"))
               .where("low <> high").select("token"))
    matrix = written(moved.join(several, "token").join(sets.select("number", *SIGNATURE), "number"), "matrix")
    # The smaller set of a pair, or of two equal ones the first, is found by fewer of its tokens.
    pairs = (side(matrix.where("first"), "a", SIGNATURE).join(side(matrix, "b", SIGNATURE), "token")
             .where(((F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("number_a") < F.col("number_b")))
                    & _fits() & _near_signatures())
             .select("number_a", "number_b").distinct())
    return first.union(_compared(pairs, sets))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id reachable by links (itself included).

    Two documents link when their sets of five-word shingles (words are runs of
    non-white-space, A-Z in lower case) have a Jaccard similarity of 0.8 or
    more. A null text or one without words has an empty set and no link. A row
    with a null id has its n_shingles, a null component_id and no link. Rows
    with the same id and text give equal rows. An empty table gives none.
    Columns other than doc_id and text are not read.
    """
    named = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    schema = "key long, of long, n int, kind tinyint"
    first = written(map_batches(map_batches(named, _send_samples, schema).repartition("key").sortWithinPartitions("key"),
                                _count_shared, schema), "samples")
    rows = first.where(F.col("kind") == DOCUMENT).select(F.col("key").alias("doc_id"), F.col("of").alias("set"),
                                                         F.col("n").alias("n"))
    shared = first.where(F.col("kind") == COUNT).groupBy(F.col("of").alias("set")).agg(F.sum("n").alias("shared"))
    one = rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    open_sets = written(one.join(shared, "set").where(_needed(F.col("shared"), F.col("n"))).select(
        "set", "doc_id", (F.col("shared") / F.col("n")).alias("share")), "open")

    def full(batches) -> Iterable:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(7 + len(SIGNATURE))]
                for own, share, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    tokens = shingle_set(text)
                    if set_id(tokens) != own:  # another text under the same id
                        continue
                    rehashed = [int(_mix(tokens.view(np.uint64) ^ odd).min().view(np.int64)) for odd in _ODD[1:3]]
                    for column, cell in zip(out, (number, own, len(tokens), tokens, *rehashed, share, *signature(tokens)), strict=True):
                        column.append(cell)
                    number += 1
                yield out

    texts = named.join(_maybe_broadcast(open_sets, open_sets.count()), "doc_id").select("set", "share", "text")
    sets = written(map_batches(texts, full, "number long, set long, n int, tokens array<long>, bucket0 long, bucket1 long, "
                               "share double, " + ", ".join(f"{c} long" for c in SIGNATURE)), "sets")
    links = written(_leader_links(sets), "links")
    grouped = written(components(links).select(F.col("a").alias("set"), "root"), "groups")
    links = _open_groups(sets, grouped).union(
        grouped.select(F.col("set").alias("a"), F.col("root").alias("b")))
    grouped = components(links).select(F.col("a").alias("set"), "root")

    placed = rows.join(grouped, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"),
                                                      F.count(F.lit(1)).alias("size")).where("size > 1")
    found = placed.join(least.select("root", "component_id"), "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))

    def sizes(batches) -> Iterable:
        for batch in batches:
            yield batch.column(0), [len(shingle_set(t)) for t in batch.column(1).to_pylist()], [None] * batch.num_rows

    unnamed = map_batches(docs.where("doc_id IS NULL").select("doc_id", "text"), sizes,
                          "doc_id long, n_shingles long, component_id long")
    return found.unionByName(unnamed)
