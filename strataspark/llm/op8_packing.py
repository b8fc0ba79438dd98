"""Best-fit packing of token sequences, improved by a local search that swaps documents between underfull bins.

Documents are tokenized where they lie; only (document, piece, length) rows are checkpointed and shuffled, dealt
by a counter into groups of about GROUP documents, so that no task holds more than a group, whatever ids repeat. The
checkpoint fixes which group a piece is in, so a lost executor can't move it to another. In a group the pieces
go best-fit decreasing into bins. Then the emptiest bins give their documents to others by moves,
one-for-one and two-for-one swaps. Each step raises the sum of squared fills; a bin that gets
empty is gone. A group ends with about one underfull bin, a share that the group size fixes.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice
from sys import byteorder
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import cut, read, small_batches, text_of

GROUP, CACHE, KEEP, ROUNDS = 8192, 500_000, 100_000, 4
DONORS = 4
TAIL = ".,!?;:$%&#*"
SPECIAL_OR_MARK = r"<\||\p{M}"
PIECES = "piece int, start long, length long, ids_crc32 long"


#: The visible character that byte-level BPE writes for each byte.
_BYTES = {b: c for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)], strict=True)}
_BYTES |= {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _BYTES)}


def _bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    if byteorder == "big":
        a.byteswap()
    return a.tobytes()


def by_words(path: str) -> bool:
    """Whether a tokenizer file has the normal form and the pieces that Encoder's way by words rests on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [(n.get("type"), n.get("pattern"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    pieces = [(p.get("type"), p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return (
        normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and pieces == [("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
        and not (spec["truncation"] or spec["padding"] or spec["model"].get("continuing_subword_prefix"))
    )


def ends_in_letter(core: str) -> bool:
    """A letter or number is the last character of the word's lower-case normal form too: of those that lower-casing lengthens, some end in a mark."""
    last = core[-1:]
    return last.isalnum() and (last.isascii() or normalize("NFC", core).lower()[-1].isalnum())


class Encoder:
    """Word-by-word use of a byte-level BPE tokenizer whose pre-tokenizer never crosses a space, with a bounded cache.

    Signs in TAIL at a word's end, after a letter or number, are always tokens apart from it, so they are
    cut off, and the rest is encoded once however it was punctuated. A rest of Latin letters alone, which has no other
    normal form, is one piece for the pre-tokenizer: it goes to the model at once, lower-cased. Files of other
    tokenizers encode whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.known, self.by_words = Tokenizer.from_file(path), {}, by_words(path)
        self.model = Tokenizer(self.whole.model)

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        letters, rest = [], []
        for w in words:
            (letters if w.isalpha() and (w.isascii() or max(w) < "\u0250" and w.lower().isalpha()) else rest).append(w)
        low = [w.lower() for w in letters]
        once = list(set(low))
        seen = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in once]
        ids = {w: _bytes(c.ids) for w, c in zip(once, self.model.encode_batch_fast(seen, add_special_tokens=False), strict=True)}
        out = dict(zip(letters, map(ids.__getitem__, low), strict=True))
        for w, c in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[w] = _bytes(c.ids)
        return out

    def codes(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit numbers."""
        known = self.known
        new = [w for w in words if w not in known]
        parts = {w: (core, w[len(core) :]) for w in new if (core := w.rstrip(TAIL)) != w and ends_in_letter(core)}
        need = set(new).difference(parts)
        need.update(x for pair in parts.values() for x in pair)
        fresh = self._encode(list(need.difference(known)))
        for w, (core, tail) in parts.items():
            fresh[w] = (fresh.get(core) or known[core]) + (fresh.get(tail) or known[tail])
        if len(known) + len(fresh) <= CACHE:  # the words met first are the frequent ones
            known.update(fresh)
            return [known[w] for w in words]
        return [known[w] if w in known else fresh[w] for w in words]

    def trim(self) -> None:
        """Keeps the KEEP words met first: a worker lives on after the task, and other stages need its memory."""
        if len(self.known) > KEEP:
            self.known = dict(islice(self.known.items(), KEEP))

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids. Texts are split and their words numbered as Arrow columns; only different words become Python strings.

        A-Z are lower-cased first, as the tokenizer would, but for texts that may hold one of its special tokens, or marks: it
        composes these with letters before it lower-cases."""
        if not self.by_words:
            yield from (np.asarray(c.ids, "<u4") for c in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False))
            return
        low = pc.if_else(pc.match_substring_regex(texts, SPECIAL_OR_MARK), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(low)
        words = lists.flatten().dictionary_encode()
        codes = self.codes(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        data, starts = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        ids = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + n, n)]
        offsets = lists.offsets.to_numpy()
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, for all its tasks."""
    return Encoder(path)


def _pieces(path: str, capacity: int, end_id: int, groups: int, with_ids: bool):
    end = np.asarray([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, k = encoder(path), TaskContext.get().partitionId() * 7919
        for batch in batches:
            row, out = [], {c: [] for c in ("piece", "start", "length", "ids_crc32", "_group", *(["ids"] if with_ids else []))}
            for i, code in enumerate(encode(batch.column("text"))):
                code = np.append(code, end)
                for piece, b in enumerate(range(0, len(code), capacity)):
                    part = code[b : b + capacity]
                    row.append(i)
                    for c, v in zip(out, (piece, b, len(part), zlib.crc32(part.tobytes()), k % groups, part.astype("i4") if with_ids else None), strict=False):
                        out[c].append(v)
                k += 1
            types = {"piece": pa.int32(), "_group": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(v, types.get(c, pa.int64())) for c, v in out.items())], names=["doc_id", *out])
        encode.trim()

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    room, mask, bins = {}, 0, []  # room: free tokens -> numbers of bins; mask: a bit for each key of room
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        left = free - n
        room.setdefault(left, []).append(b)
        mask |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, rounds: int = ROUNDS) -> list[list[int]]:
    """Swaps documents between underfull bins while that raises the sum of squared fills; drops emptied bins.

    It works on the emptiest bins, DONORS for each bin over the number that the total needs, and ends when that is reached.
    A step always goes from an emptier bin to a fuller one, so the sum rises and the search ends."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)  # fewer bins can't hold all
    alive = len(bins)
    for _ in range(rounds):
        changed = False
        open_ = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        for at, b in enumerate(open_[: DONORS * max(0, alive - least)]):
            for a in reversed(open_[at + 1 :]):
                if alive == least or not bins[b]:
                    break
                if fill[a] >= fill[b] and (step := _step(bins[b], bins[a], lengths, capacity - fill[a])):
                    out, back = step
                    bins[b] = [i for i in bins[b] if i not in out] + back
                    bins[a] = [i for i in bins[a] if i not in back] + list(out)
                    gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                    fill[a], fill[b], changed = fill[a] + gain, fill[b] - gain, True
                    alive -= not bins[b]
        if not changed or alive == least:
            break
    return [b for b in bins if b]


def _step(giver: list[int], taker: list[int], lengths: list[int], free: int) -> tuple[set[int], list[int]] | None:
    """The items that go over and come back so that taker grows most, by at most free: a move, one for one, or two for one.

    Items of one length are alike, so only different lengths are tried: a bin of many short documents has few of them."""
    if not free:
        return None
    own, back = {}, {}
    for i in giver:
        own.setdefault(lengths[i], []).append(i)
    for j in taker:
        back.setdefault(lengths[j], j)
    one = np.array(sorted(own))
    first, second = np.triu_indices(len(one))
    possible = (first != second) | np.array([len(own[n]) > 1 for n in one.tolist()])[first]
    first, second = first[possible], second[possible]
    out = np.concatenate([one, one[first] + one[second]])
    sizes = np.array([0, *sorted(back)])  # 0: nothing comes back, which only one item may ask for
    at = np.searchsorted(sizes, out - free)  # the smallest that may come back
    at[len(one) :] = np.maximum(at[len(one) :], 1)
    gain = np.where(at < len(sizes), out - sizes[np.minimum(at, len(sizes) - 1)], 0)
    k = int(gain.argmax())
    if gain[k] <= 0:
        return None
    n = sizes[at[k]]
    if k < len(one):
        goes = {own[int(one[k])][0]}
    else:
        a, b = int(one[first[k - len(one)]]), int(one[second[k - len(one)]])
        goes = {own[a][0], own[b][1 if a == b else 0]}
    return goes, [back[int(n)]] if n else []


def _packer(capacity: int):
    def place_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        first = int(pdf["_group"].iloc[0]) << 32
        for k, b in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            place = 0
            for i in b:
                seq[i], off[i] = first + k, place
                place += lengths[i]
        return pdf.drop(columns="_group").assign(sequence_id=seq, offset=off)

    return place_all


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, with_ids).

    A document is its tokens and end_id; null and empty texts are end_id alone. Only longer documents
    than capacity are cut, at multiples of it. Sequences hold at most capacity tokens, gapless from 0.
    Repeated rows and ids are packed one by one, as separate documents; null doc_ids stay null. An empty table gives no rows.
    Other columns aren't carried, so clashing names don't matter. Equal lengths go by doc_id."""
    kind = dict(docs.dtypes)["doc_id"]
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // GROUP))
    ids = ", ids array<int>" if with_ids else ""
    slim = docs.select("doc_id", text_of(docs).alias("text"))
    pieces = cut(slim.mapInArrow(_pieces(tokenizer, capacity, end_id, groups, with_ids), f"doc_id {kind}, {PIECES}, _group int{ids}"))
    return pieces.groupBy("_group").applyInPandas(_packer(capacity), f"doc_id {kind}, {PIECES}{ids}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
