"""Token-id files coded by a static range asymmetric numeral system (rANS).

Writing, all as Spark jobs:

1. documents are sorted by ``doc_id`` (range partitions, nulls last; equal keys
   split by a hash of the text so that a repeated key spreads over tasks),
   encoded with a ``tokenizers`` vocabulary, and given the end id; the ids are
   staged once in the shared folder, with the partition and place of each
   document in the sorted order;
2. one histogram of all ids, summed map-side, is scaled to ``2**SCALE``: the
   shared frequency table.  Its size is bounded by the vocabulary;
3. each task cuts its documents into blocks of about ``BLOCK`` ids and codes a
   block with ``LANES`` interleaved rANS states (id ``t`` goes to lane
   ``t % LANES``), so that both coding directions are numpy operations over all
   lanes at once.  A block row holds its documents, the final lane states and
   the lane streams, and crc32 checksums of the ids and of the coded words.

The format is a folder: ``table`` (symbol, freq, cum, scale) and ``blocks``.  A
block is a checkpoint: it decodes alone, from its own states, so the reader
decodes every block in its own task and checks both checksums.  Global starts
come from per-partition totals (one number per partition reaches the driver).

Cases: a null text is encoded as an empty one (only the end id).  Null
``doc_id`` rows come after all others.  Repeated rows are separate documents.
Extra columns are ignored.  An empty table writes an empty folder of blocks.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.llm import kernels as K
from glyphloom.session import stage, staging_folder

#: state bounds: 64-bit states in [LOW, LOW << 32), 32-bit words out
LOW = 1 << 31
SCALE = 20
LANES = 256
BLOCK = 1 << 20
#: the end id appended to every document, fixed by the query's contract
END_ID = 2
#: characters of text encoded together and handed back in one frame, except those of a longer text
TEXT_CHARS = 1 << 22
#: words or pieces whose ids a worker keeps, and the bytes up to which it keeps one
KEPT_WORDS, KEPT_BYTES = 1 << 20, 64
#: blocks coded side by side, each with its own lanes
SIDE = 4
#: pre-tokenising pattern known to have no match with a blank in it
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: what ``WORD_PATTERN`` sees in a character: no part of a piece, a letter, a number, another mark;
#: and a word with characters beyond Latin-1, which is not cut
BLANK, LETTER, NUMBER, MARK, FOREIGN = range(5)
#: of the characters of Latin-1 in lower case
KINDS = np.full(256, MARK, np.uint8)
KINDS[[*range(9, 14), 32, 0x85, 0xA0]] = BLANK
KINDS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzªµº"] + [k for k in range(0xDF, 0x100) if k != 0xF7]] = LETTER
KINDS[[ord(c) for c in "0123456789²³¹¼½¾"]] = NUMBER
LOWER = np.array([ord(chr(k).lower()) for k in range(256)], np.uint8)

_tokenizers: dict[str, object] = {}
_encoders: dict[tuple[str, int], _Encoded] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def blanks_separate(spec: dict) -> bool:
    """Whether a text's ids are those of its parts between blanks, one after the other.

    Told from the tokenizer's file, and True only for what is known: characters normalised without
    a view over a blank, pieces by ``WORD_PATTERN`` and nothing between them, and merges inside a piece.
    """
    def parts(kind: str, several: str) -> list[dict]:
        one = spec.get(kind) or {}
        return one.get(several, []) if one.get("type") == "Sequence" else [one] if one else []

    def known(n: dict) -> bool:
        return n["type"] in ("NFC", "Lowercase") or (
            n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ")

    cuts = parts("pre_tokenizer", "pretokenizers")
    first, rest = cuts[0] if cuts else {}, cuts[1:]
    return (
        all(known(n) for n in parts("normalizer", "normalizers"))
        and first.get("type") == "Split" and first["pattern"] == {"Regex": WORD_PATTERN}
        and first["behavior"] == "Removed" and first["invert"]
        and all(r["type"] == "ByteLevel" and not r["add_prefix_space"] and not r["use_regex"] for r in rest)
        and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        and not (spec.get("post_processor") or spec.get("truncation") or spec.get("padding"))
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])))


def pieces_apart(spec: dict) -> bool:
    """Whether the ids of a Latin-1 word are those its pieces (``_cut``), in lower case, have in the model.

    Beyond ``blanks_separate``: Latin-1 text is its own NFC form, and added tokens are looked for in the raw word.
    """
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (blanks_separate(spec) and "Lowercase" in kinds and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and not any(t["normalized"] or t["single_word"] for t in spec.get("added_tokens", [])))


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lowered, inside, starts``: the matches of ``WORD_PATTERN`` in UTF-8 bytes, which end in a blank.

    ``inside`` marks the bytes of pieces and ``starts`` their first ones. A word with characters beyond
    Latin-1 is one piece and keeps its case.
    """
    low, kind = LOWER[data], KINDS[LOWER[data]]
    first = data >= 0xC2  # of a character of several bytes
    lead = np.flatnonzero(first)
    tail = (data >= 0x80) & ~first
    if len(lead):
        latin = lead[data[lead] < 0xC4]
        code = LOWER[(data[latin] & 3) << 6 | data[latin + 1] & 63]
        low[lead] = data[lead]
        low[latin + 1] = code & 63 | 128
        foreign = lead[data[lead] >= 0xC4]
        if len(foreign):
            blank = np.append(True, KINDS[data] == BLANK)
            blank[1:] &= data < 0x80
            begin, end = (np.flatnonzero(x) for x in (blank[:-1] & ~blank[1:], ~blank[:-1] & blank[1:]))
            word = np.unique(np.searchsorted(begin, foreign, side="right") - 1)
            edge = np.zeros(len(data) + 1, np.int8)
            edge[begin[word]], edge[end[word]] = 1, -1
            whole = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        kind[latin] = kind[latin + 1] = KINDS[code]
        if len(foreign):
            kind[whole] = FOREIGN
            low[whole] = data[whole]
    starts = np.append(True, kind[1:] != kind[:-1]) & (kind != BLANK)
    starts |= (kind == NUMBER) & ~tail
    mark = np.flatnonzero((low == ord("'")) & starts & (kind == MARK))
    if len(mark):  # 's and the like are one piece where no mark is before them
        one, two = low[mark + 1], low[np.minimum(mark + 2, len(low) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        same = kind[mark + 1] == LETTER  # not in a word beyond Latin-1
        for which, size in ((mark[short & same], 2), (mark[long & same], 3)):
            starts[which + 1] = False
            starts[which + size] |= kind[which + size] != BLANK
    return low, kind != BLANK, starts


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_cut``: the words between blanks as they are."""
    inside = (KINDS[data] != BLANK) | (data >= 0x80)
    return data, inside, inside & np.append(True, ~inside[:-1])


class _Encoded:
    """The ids of texts by the tokenizer, and of the words or pieces met before.

    Many texts are cut at once by array operations and each new word goes to the tokenizer once. Where
    ``pieces_apart`` holds, the texts are cut into pieces instead, whose ids the tokenizer's model gives:
    a word that is new is mostly known pieces, or a known one in other case or with other marks.
    """

    def __init__(self, tokenizer, end: int):
        spec = json.loads(tokenizer.to_str())
        self.tokenizer, self.end = tokenizer, np.uint32(end).tobytes()
        self.by_words = blanks_separate(spec)
        self.model = getattr(tokenizer, "model", None) if pieces_apart(spec) else None
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        """Nothing is known but the end id, in the place of the empty word."""
        self.known = pa.array([b""], pa.binary())
        self.sizes, self.flat = np.ones(1, np.int32), np.frombuffer(self.end, np.uint32)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, with the end id."""
        if not self.by_words:
            return [self._whole(t) + self.end for t in texts]
        whole = {k: self._whole(t) + self.end for k, t in enumerate(texts) if any(a in t for a in self.added)}
        out = self._joined(["" if k in whole else t for k, t in enumerate(texts)] if whole else texts)
        for k, raw in whole.items():
            out[k] = raw
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        if len(texts) > 1 or len(texts[0]) <= TEXT_CHARS:
            return self._slice(texts)
        text, at, parts = texts[0], 0, []
        while at < len(text):  # cut behind a blank; a word longer than a part stays whole
            to = at + TEXT_CHARS
            if to < len(text):
                behind = 1 + max(text.rfind(" ", at, to), text.rfind("\n", at, to))
                to = behind or min([k for k in (text.find(" ", to), text.find("\n", to)) if k >= 0], default=len(text))
            parts.append(self._slice([text[at:to]])[0][:-4])
            at = to
        return [b"".join(parts) + self.end]

    def _slice(self, texts: list[str]) -> list[bytes]:
        data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
        low, inside, starts = (_cut if self.model is not None else _words)(data)
        bounds = np.append(np.flatnonzero(starts[inside]), np.count_nonzero(inside)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
            None, pa.py_buffer(bounds), pa.py_buffer(low[inside])])
        coded = pa.concat_arrays([self.known, units]).dictionary_encode()
        codes = coded.indices.to_numpy()[len(self.known):]
        self._learn(coded.dictionary)
        # the end id of a text stands behind its last unit
        last = np.searchsorted(np.flatnonzero(starts), _ends(texts))
        codes = np.insert(codes, last, 0)
        size = self.sizes[codes]
        to = np.cumsum(size, dtype=np.int32)
        first = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        raw = self.flat[np.repeat(first[codes] - (to - size), size) + np.arange(to[-1], dtype=np.int32)].tobytes()
        cuts = [0, *(4 * to[last + np.arange(len(last))].astype(np.int64)).tolist()]
        self._keep(codes)
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, units: pa.Array) -> None:
        """``units`` begin with those known."""
        new = [self._unit(u) for u in units.slice(len(self.known)).cast(pa.string()).to_pylist()]
        self.known = units
        self.sizes = np.append(self.sizes, np.array([len(n) for n in new], np.int32))
        self.flat = np.append(self.flat, np.fromiter(itertools.chain.from_iterable(new), np.uint32))

    def _keep(self, codes: np.ndarray) -> None:
        """Long units are forgotten; when too many are known also those that the last texts did not have."""
        keep = np.diff(np.frombuffer(self.known.buffers()[1], np.int32)[:len(self.known) + 1]) <= KEPT_BYTES
        if np.count_nonzero(keep) > KEPT_WORDS:
            used = np.zeros(len(keep), bool)
            used[codes] = True
            keep &= used
            if np.count_nonzero(keep) > KEPT_WORDS:
                return self._forget()
        keep[0] = True
        if not keep.all():
            self.known = self.known.filter(pa.array(keep))
            self.flat = self.flat[np.repeat(keep, self.sizes)]
            self.sizes = self.sizes[keep]

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> list[int]:
        if self.model is None or not unit.isascii() and max(unit) > "ÿ":
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        if not (unit.isascii() and unit.isprintable()):
            unit = unit.translate(_byte_level())
        return [t.id for t in self.model.tokenize(unit)]


def _ends(texts: list[str]) -> np.ndarray:
    """Where each text ends in the bytes of all, a line break between them."""
    return np.cumsum([len(t if t.isascii() else t.encode()) + 1 for t in texts]) - 1


@functools.cache
def _byte_level() -> dict[int, str]:
    """The characters by which the tokenizer's model sees the bytes of a character of Latin-1."""
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(256)}


def _encoder_of(path: str, end: int) -> _Encoded:
    """One for each tokenizer, end id and worker: what a task has kept serves the next one."""
    tok, key = _tokenizer(path), (path, end)
    if key not in _encoders or _encoders[key].tokenizer is not tok:
        _encoders[key] = _Encoded(tok, end)
    return _encoders[key]


def _together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``TEXT_CHARS`` characters, or one text."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size + len(t) > TEXT_CHARS and k > begin:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _tokenize(path: str, end: int):
    """The ids of each text alone, word by word where blanks separate its pieces, in frames of a few texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoded, seq = _encoder_of(path, end), 0
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in _together(texts):
                yield pd.DataFrame({"part": batch["part"].to_numpy()[a:b],
                                    "seq": np.arange(seq, seq + b - a, dtype=np.int64),
                                    "doc_id": batch["doc_id"].to_numpy()[a:b], "ids": encoded.ids(texts[a:b])})
                seq += b - a
    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros(0, np.int64)
        for _, raw, _ in K.pieces(batch.column("ids")):
            c = np.bincount(raw.copy().view(np.uint32))
            if len(c) > len(counts):
                counts = np.pad(counts, (0, len(c) - len(counts)))
            counts[:len(c)] += c
        sym = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(sym, pa.int64()), pa.array(counts[sym])], names=["symbol", "n"])


def frequency_table(counts: dict[int, int], scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``symbols, freq, cum``: counts scaled to sum ``2**scale``, each present symbol at least 1."""
    symbols = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in symbols], np.float64)
    total = 1 << scale
    if len(symbols) > total:
        raise ValueError(f"{len(symbols)} symbols do not fit a table of {total}")
    freq = np.maximum(1, np.floor(n * total / n.sum())).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    gap, i = total - int(freq.sum()), 0
    while gap:
        j = order[i % len(order)]
        step = gap if gap > 0 else -min(-gap, int(freq[j]) - 1)
        freq[j] += step
        gap -= step
        i += 1
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    return symbols, freq, cum


def _side_by_side(sizes: list[int], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``order, full, active``: blocks by their full steps, longest first, and how many have each step."""
    full = np.array(sizes, np.int64) // lanes
    order = np.argsort(-full, kind="stable")
    full = full[order]
    return order, full, np.searchsorted(-full, -np.arange(full[0]), side="left")


def _pairs(freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """Frequency and cumulative frequency of a symbol in one number."""
    return freq.astype(np.uint64) << np.uint64(32) | cum.astype(np.uint64)


def encode_blocks(blocks: list[np.ndarray], symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray,
                  lanes: int = LANES, scale: int = SCALE) -> list[tuple[bytes, bytes, bytes]]:
    """``states, lengths, words`` of each block: its lanes' final states and word streams."""
    small = np.min_scalar_type(len(symbols))
    place = np.zeros(int(symbols[-1]) + 1, small)  # as many as the vocabulary has ids
    place[symbols] = np.arange(len(symbols))
    order, full, active = _side_by_side([len(b) for b in blocks], lanes)
    at = np.empty((int(full[0]), len(blocks), lanes), small)
    for k, b in enumerate(order):
        at[:full[k], k] = place[blocks[b][:full[k] * lanes]].reshape(full[k], lanes)
    at = at.reshape(len(at), len(blocks) * lanes)
    pairs, x = _pairs(freq, cum), np.full(len(blocks) * lanes, LOW, np.uint64)
    half, rest, total = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(1 << scale)
    most = np.uint64((LOW >> scale) << 32)
    out_lane, out_word, kind = [], [], np.min_scalar_type(len(x))

    def push(first: int, at: np.ndarray) -> None:
        xs, pair = x[first:first + len(at)], pairs[at]  # the states are a view
        f = pair >> half
        emit = np.flatnonzero(xs >= f * most)
        if len(emit):
            high = xs[emit]
            out_lane.append((emit + first).astype(kind))
            out_word.append(high.astype(np.uint32))
            xs[emit] = high >> half
        # (x // f << scale) + x % f + c
        pair &= rest
        pair += (xs // f) * (total - f)
        xs += pair

    for k, b in enumerate(order):  # the last step of a block may fill its first lanes only
        push(k * lanes, place[blocks[b][full[k] * lanes:]])
    for step in range(len(at) - 1, -1, -1):
        push(0, at[step, :active[step] * lanes])
    lane = np.concatenate(out_lane) if out_lane else np.zeros(0, kind)
    word = np.concatenate(out_word) if out_word else np.zeros(0, np.uint32)
    # the decoder reads each lane's words in the reverse order of writing
    word = word[::-1][np.argsort(lane[::-1], kind="stable")].astype("<u4")
    lengths = np.bincount(lane, minlength=len(x)).astype(np.uint32).reshape(-1, lanes)
    ends = np.append(0, np.cumsum(lengths.sum(axis=1, dtype=np.int64)))
    out = {b: (x[k * lanes:(k + 1) * lanes].tobytes(), lengths[k].tobytes(), word[ends[k]:ends[k + 1]].tobytes())
           for k, b in enumerate(order)}
    return [out[b] for b in range(len(blocks))]


def encode_block(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray,
                 lanes: int = LANES, scale: int = SCALE) -> tuple[bytes, bytes, bytes]:
    """``encode_blocks`` of one block."""
    return encode_blocks([ids], symbols, freq, cum, lanes, scale)[0]


def decode_blocks(blocks: list[tuple[int, bytes, bytes, bytes]], symbols: np.ndarray, freq: np.ndarray,
                  cum: np.ndarray, slot_symbol: np.ndarray, lanes: int = LANES, scale: int = SCALE) -> list[np.ndarray]:
    """The ids of each block, of which the number, ``states``, ``lengths`` and ``words`` are given."""
    order, full, active = _side_by_side([b[0] for b in blocks], lanes)
    x = np.concatenate([np.frombuffer(blocks[b][1], np.uint64) for b in order])
    size = np.concatenate([np.frombuffer(blocks[b][2], np.uint32) for b in order]).astype(np.int64)
    stream = np.concatenate([np.frombuffer(blocks[b][3], "<u4") for b in order]).astype(np.uint64)
    told = size.reshape(len(blocks), lanes).sum(axis=1).tolist()
    if told != [len(blocks[b][3]) // 4 for b in order]:
        raise ValueError("corrupt block: streams of other lengths")
    ends = np.cumsum(size)
    read = ends - size  # the place of each lane's next word
    out = np.empty((int(full[0]), len(x)), slot_symbol.dtype)
    pairs = _pairs(freq, cum)
    mask, low, by, half = np.uint64((1 << scale) - 1), np.uint64(LOW), np.uint64(scale), np.uint64(32)
    rest = np.uint64(0xFFFFFFFF)

    def pull(first: int, n: int) -> np.ndarray:
        xs = x[first:first + n]
        slot = xs & mask
        at = slot_symbol[slot.view(np.int64)]
        pair = pairs[at]
        xs >>= by
        xs *= pair >> half
        pair &= rest
        slot -= pair
        xs += slot
        need = np.flatnonzero(xs < low)
        if len(need):
            mine = need + first
            place = read[mine]
            if (place >= ends[mine]).any():
                raise ValueError("corrupt block: a lane ran out of words")
            xs[need] = (xs[need] << half) | stream[place]
            read[mine] = place + 1
        return at

    for step, k in enumerate(active):
        out[step, :k * lanes] = pull(0, k * lanes)
    known, found = symbols.astype(np.uint32), {}
    for k, b in enumerate(order):
        last = pull(k * lanes, blocks[b][0] - int(full[k]) * lanes)
        found[b] = known[np.append(out[:full[k], k * lanes:(k + 1) * lanes], last)]
    if np.any(x != low) or np.any(read != ends):
        raise ValueError("corrupt block: states or streams do not end where they began")
    return [found[b] for b in range(len(blocks))]


def decode_block(n: int, states: bytes, lengths: bytes, words: bytes, symbols: np.ndarray, freq: np.ndarray,
                 cum: np.ndarray, slot_symbol: np.ndarray, lanes: int = LANES, scale: int = SCALE) -> np.ndarray:
    """The ``n`` ids of one block."""
    return decode_blocks([(n, states, lengths, words)], symbols, freq, cum, slot_symbol, lanes, scale)[0]


def _encoder(symbols, freq, cum, lanes, scale, block):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, full = [], []

        def flush():
            frames = [pd.DataFrame(rows, columns=["part", "seq", "doc_id", "ids"]) for rows in full]
            ids = [np.frombuffer(b"".join(d["ids"]), np.uint32) for d in frames]
            full.clear()
            for docs, i, (states, lengths, words) in zip(
                    frames, ids, encode_blocks(ids, symbols, freq, cum, lanes, scale)):
                yield _block_frame([{
                    "part": docs["part"].to_numpy(), "seq": docs["seq"].to_numpy(),
                    "doc_id": docs["doc_id"].astype("Int64"), "n": [len(b) // 4 for b in docs["ids"]],
                    "n_ids": len(i), "states": states, "lengths": lengths, "words": words,
                    "ids_crc32": zlib.crc32(i.astype("<u4").tobytes()), "words_crc32": zlib.crc32(words)}])

        size = 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                held.append((r.part, r.seq, r.doc_id, r.ids))
                size += len(r.ids) // 4
                if size >= block:
                    full.append(held)
                    if len(full) == SIDE or size > 2 * block:  # one with a very long document is not held back
                        yield from flush()
                    held, size = [], 0
        if held:
            full.append(held)
        if full:
            yield from flush()

    return run


BLOCKS = ("parts array<int>, seqs array<long>, doc_ids array<long>, counts array<long>, n_ids long, "
          "states binary, lengths binary, words binary, ids_crc32 long, words_crc32 long")


def _block_frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({
        "parts": [r["part"].astype(np.int32) for r in rows], "seqs": [r["seq"].astype(np.int64) for r in rows],
        "doc_ids": [list(r["doc_id"].astype(object).where(r["doc_id"].notna(), None)) for r in rows],
        "counts": [np.array(r["n"], np.int64) for r in rows], "n_ids": [r["n_ids"] for r in rows],
        "states": [r["states"] for r in rows], "lengths": [r["lengths"] for r in rows],
        "words": [r["words"] for r in rows], "ids_crc32": [r["ids_crc32"] for r in rows],
        "words_crc32": [r["words_crc32"] for r in rows]})


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None,
                      end: int = END_ID, lanes: int = LANES, scale: int = SCALE, block: int = BLOCK) -> str:
    """Encode ``docs`` (``doc_id, text``) into a folder of the format above; returns the folder."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    folder = folder or f"{staging_folder(spark).rstrip('/')}/glyphloom/tokens-{uuid.uuid4().hex}"
    sort = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").alias("h1"), F.crc32(F.coalesce("text", F.lit("")))]
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy(*sort)
               .withColumn("part", F.spark_partition_id()))
    tokens = stage(ordered.mapInPandas(_tokenize(vocabulary, end), "part int, seq long, doc_id long, ids binary"))
    counts = {r["symbol"]: r["n"] for r in tokens.select("ids").mapInArrow(_histogram, "symbol long, n long")
              .groupBy("symbol").agg(F.sum("n").alias("n")).collect()}
    symbols, freq, cum = frequency_table(counts or {end: 1}, scale)
    spark.createDataFrame(pd.DataFrame({"symbol": symbols, "freq": freq, "cum": cum, "scale": scale,
                                        "lanes": lanes})).coalesce(1).write.parquet(f"{folder}/table")
    tokens.mapInPandas(_encoder(symbols, freq, cum, lanes, scale, block), BLOCKS).write.parquet(f"{folder}/blocks")
    return folder


def _decoder(symbols, freq, cum, lanes, scale, keep_ids):
    slot_symbol = np.repeat(np.arange(len(symbols), dtype=np.min_scalar_type(len(symbols))), freq)

    def some(rows: list) -> pd.DataFrame:
        for r in rows:
            if zlib.crc32(r.words) != r.words_crc32:
                raise ValueError("corrupt block: checksum of the coded words")
        blocks = decode_blocks([(int(r.n_ids), r.states, r.lengths, r.words) for r in rows], symbols, freq, cum,
                               slot_symbol, lanes, scale)
        out = []
        for r, ids in zip(rows, blocks):
            raw = ids.astype("<u4").tobytes()
            if zlib.crc32(raw) != r.ids_crc32:
                raise ValueError("corrupt block: checksum of the ids")
            ends = np.cumsum(r.counts)
            for part, seq, doc_id, lo, hi in zip(r.parts.tolist(), r.seqs.tolist(), r.doc_ids,
                                                 (ends - r.counts).tolist(), ends.tolist()):
                piece = raw[4 * lo:4 * hi]
                out.append((part, seq, doc_id, hi - lo, zlib.crc32(piece), piece if keep_ids else None))
        return pd.DataFrame(out, columns=["part", "seq", "doc_id", "n_tokens", "ids_crc32", "ids"]).astype(
            {"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(batch.itertuples(index=False))
            while rows:
                n = 1
                while n < min(SIDE, len(rows)) and sum(r.n_ids for r in rows[:n + 1]) <= 2 * SIDE * BLOCK:
                    n += 1
                yield some(rows[:n])
                rows = rows[n:]

    return run


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids`` as little-endian uint32 bytes) of a folder."""
    table = spark.read.parquet(f"{folder}/table").orderBy("symbol").toPandas()
    symbols, freq, cum = (table[c].to_numpy(np.int64) for c in ("symbol", "freq", "cum"))
    scale, lanes = (int(table[c].iloc[0]) if len(table) else d for c, d in (("scale", SCALE), ("lanes", LANES)))
    docs = stage(spark.read.parquet(f"{folder}/blocks").mapInPandas(
        _decoder(symbols, freq, cum, lanes, scale, keep_ids),
        "part int, seq long, doc_id long, n_tokens long, ids_crc32 long, ids binary"))
    totals = dict(docs.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, run = {}, 0
    for part in sorted(totals):
        offsets[part], run = run, run + totals[part]
    offset = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o).cast("long"))]) \
        if offsets else F.create_map().cast("map<int,long>")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1))
    return docs.select("doc_id", (offset[F.col("part")] + F.coalesce(before, F.lit(0))).alias("start"),
                       "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
