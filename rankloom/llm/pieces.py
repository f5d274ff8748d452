"""Encoding and decoding with a merge-type piece vocabulary, as the sentencepiece library does it.

A text's symbols start as its characters.  An agenda holds every adjacent pair whose join is a
piece, best score first, then leftmost; the best pair is joined and the pairs with its new
neighbours go on the agenda, until it is empty.  Characters that are no piece become their bytes.

A pair of characters that stands in no piece can never be joined across, so a text falls apart there
into short runs that are encoded alone and remembered.  New runs of one length are joined in
lockstep, their agendas the rows of one array; a long run has a heap of its own.
"""

import codecs
import hashlib
import heapq
import re
from functools import cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankloom.llm.common import pick

_SPACE = "▁"
#: Runs that a Python worker remembers before it starts anew, and the longest of them in characters.
REMEMBERED, LONGEST = 200_000, 32
#: Runs of a text that are looked up at once, and characters of texts that are encoded at once.
AT_ONCE, SLICE = 100_000, 1_000_000
_NONE = np.iinfo(np.int32).max
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _replace_byte(error):
    return "�", error.start + 1


codecs.register_error("rankloom_byte", _replace_byte)


class Pieces:
    """The vocabulary of a model file: ``encode(text) -> ids`` and ``decode(ids) -> text``."""

    def __init__(self, path):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {p.type for p in model.pieces}
        rules = model.normalizer_spec
        plain = not (rules.precompiled_charsmap or rules.normalization_rule_tsv or rules.remove_extra_whitespaces)
        if model.trainer_spec.model_type != 2 or kinds & {_USER, _UNUSED} or not plain or not rules.escape_whitespaces:
            raise ValueError("only merge-type models that leave the text as it is")
        self.prefix = rules.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_ids = [bytes_of[b] for b in range(256)] if len(bytes_of) == 256 else None
        surface = model.trainer_spec.unk_surface.encode()
        self.bytes = [p.piece.replace(_SPACE, " ").encode() for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == _UNKNOWN:
                self.bytes[i] = surface
            elif p.type == _CONTROL:
                self.bytes[i] = b""
            elif p.type == _BYTE:
                self.bytes[i] = bytes([int(p.piece[3:5], 16)])
        self.starts = [p.type == _NORMAL and p.piece.startswith(_SPACE) for p in model.pieces]
        self.silent = [p.type == _CONTROL for p in model.pieces]
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.runs = self._split()
        self.known = {}
        self._table()

    def _split(self):
        """A pattern that cuts where no piece reaches.

        ``lead``: characters that are no letters and that no piece has after any other than one of themselves.  So a
        cut is safe before them, and on both sides of a character that is in no piece of several characters.
        """
        joined = {c for p in self.pairs for c in p}
        lead, size = {c for c in joined if not c.isalnum()}, -1
        while len(lead) != size:
            size = len(lead)
            lead -= {p[1] for p in self.pairs if p[0] not in lead}
        first, inner = ("".join(re.escape(c) for c in sorted(some)) for some in (lead, joined - lead))
        if not joined:
            return re.compile(r"(?s:.)")
        if not lead or lead == joined:
            return re.compile(f"[{first}{inner}]+|[^{first}{inner}]+")
        return re.compile(f"[{first}]*[{inner}]+|[{first}]+|[^{first}{inner}]+")

    def _table(self):
        """Every way to make a piece of two symbols: ``left * symbols + right``, with the rank of the score and the piece."""
        single = sorted({c for p in self.ids for c in p if len(p) > 1 and c not in self.ids})
        self.single = single
        number = self.ids | {c: len(self.bytes) + i for i, c in enumerate(single)}
        self.symbols = len(self.bytes) + len(single)
        rank = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        rows = [
            (number[p[:i]] * self.symbols + number[p[i:]], rank[self.score[p]], at)
            for p, at in self.ids.items()
            for i in range(1, len(p))
            if p[:i] in number and p[i:] in number
        ]
        keys, ranks, made = (np.array(c, dtype=np.int64) for c in zip(*sorted(rows) or [(0, _NONE, 0)], strict=True))
        self.keys, self.ranks, self.made = keys, ranks.astype(np.int32), made.astype(np.int32)
        self.of_char = -2 - np.arange(0x110000, dtype=np.int32)
        for symbol, i in number.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = i

    def encode(self, text):
        """The ids of a text; an empty text has none."""
        return self.encode_all([text])[0]

    def encode_all(self, texts):
        """The ids of some texts, the runs that are new to this worker joined together."""
        marked = [(_SPACE if self.prefix and text else "") + text.replace(" ", _SPACE) for text in texts]
        out = [[] for _ in texts]
        short = [i for i, text in enumerate(marked) if len(text) <= SLICE]
        self._append([(out[i], self.runs.findall(marked[i])) for i in short])
        for i in set(range(len(texts))).difference(short):  # the runs of a very long text are never all held
            found = self.runs.finditer(marked[i])
            while part := [m.group() for m in islice(found, AT_ONCE)]:
                self._append([(out[i], part)])
        return out

    def _append(self, parts):
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        self._learn({run for _, part in parts for run in part}.difference(known))
        for ids, part in parts:
            for run in part:
                ids += known[run] if len(run) <= LONGEST else self._long(run)

    def _learn(self, runs):
        by_size = {}
        for run in runs:
            if len(run) <= LONGEST:
                by_size.setdefault(len(run), []).append(run)
        for size, some in by_size.items():
            codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(some), size)
            self._lockstep(some, self.of_char[codes])

    def _agenda(self, left, right):
        """Ranks of joins, ``_NONE`` where there is none, and the places of the joins in the table."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.ranks[at], _NONE).astype(np.int32), at

    def _lockstep(self, runs, symbols):
        """Join the best pair of every run, as long as any has one; leftmost among equals."""
        row = np.arange(len(runs))
        ranks, made = self._agenda(symbols[:, :-1], symbols[:, 1:])
        size = symbols.shape[1]
        while True:
            best = ranks.argmin(axis=1) if size > 1 else np.zeros(len(row), np.int64)
            going = ranks[np.arange(len(row)), best] < _NONE if size > 1 else np.zeros(len(row), bool)
            for i, ids in zip(row[~going].tolist(), symbols[~going].tolist(), strict=True):
                self.known[runs[i]] = self._plain(ids)
            if not going.any():
                return
            row, symbols, ranks, made, best = row[going], symbols[going], ranks[going], made[going], best[going]
            each, size = np.arange(len(row)), size - 1
            joined = self.made[made[each, best]]
            later = np.arange(size) > best[:, None]
            symbols = np.where(later, symbols[:, 1:], symbols[:, :-1])
            symbols[each, best] = joined
            later = later[:, 1:]  # the pair at the join itself is looked up anew, as is the one before it
            ranks = np.where(later, ranks[:, 1:], ranks[:, :-1])[:, : size - 1]
            made = np.where(later, made[:, 1:], made[:, :-1])[:, : size - 1]
            for at in (best - 1, best):
                some = np.flatnonzero((at >= 0) & (at < size - 1))
                at = at[some]
                ranks[some, at], made[some, at] = self._agenda(symbols[some, at], symbols[some, at + 1])

    def _plain(self, symbols):
        """Ids from symbols; what is no piece becomes its bytes."""
        if min(symbols) >= 0 and max(symbols) < len(self.bytes):
            return symbols
        out = []
        for s in symbols:
            if 0 <= s < len(self.bytes):
                out.append(s)
            else:
                out += self._fallback(chr(-2 - s) if s < 0 else self.single[s - len(self.bytes)])
        return out

    def _fallback(self, char):
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def _long(self, run):
        ids = []
        for symbol in self._joined(run):
            known = self.ids.get(symbol)
            ids += self._fallback(symbol) if known is None else [known]
        return ids

    def _joined(self, run):
        """The symbols of a run after all joins, by the agenda."""
        score, n = self.score, len(run)
        symbols = list(run)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            best = score.get(run[i : i + 2])
            if best is not None:
                agenda.append((-best, i, run[i : i + 2]))
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != len(joined) or left + symbols[j] != joined:
                continue  # one of the two has been joined with another since
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                piece = joined + symbols[k]
                best = score.get(piece)
                if best is not None:
                    heapq.heappush(agenda, (-best, i, piece))
            h = before[i]
            if h >= 0:
                piece = symbols[h] + joined
                best = score.get(piece)
                if best is not None:
                    heapq.heappush(agenda, (-best, h, piece))
        return [s for s in symbols if s is not None]

    def decode(self, ids):
        """The text of ids; bytes that are no UTF-8 become one replacement character each."""
        text = b"".join(map(self.bytes.__getitem__, ids))
        first = next((i for i in ids if not self.silent[i]), None) if self.prefix else None
        if first is not None and self.starts[first]:
            text = text[1:]
        return text.decode("utf-8", "rankloom_byte")


@cache
def pieces(path):
    """The vocabulary of this Python worker."""
    return Pieces(path)


def _slices(batch):
    """Rows of a batch, about ``SLICE`` characters at once: ``(first row, texts)``; null is empty."""
    first, texts, total = 0, [], 0
    for i in range(batch.num_rows):
        texts.append(batch.column(1)[i].as_py() or "")
        total += len(texts[-1])
        if total >= SLICE:
            yield first, texts
            first, texts, total = i + 1, [], 0
    if texts:
        yield first, texts


def encode(docs, path, key="doc_id", text="text"):
    """``key, ids`` (array of ints): the ids of each whole text, null and empty texts none."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches):
        model = pieces(path)
        for batch in batches:
            for first, some in _slices(batch):
                ids = pa.array(model.encode_all(some), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), ids], names=[key, "ids"])

    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def decode(encoded, path, key="doc_id", ids="ids"):
    """``key, text`` from arrays of ids; a null array gives the empty text."""
    schema = f"{key} {encoded.schema[key].dataType.simpleString()}, text string"

    def run(batches):
        model = pieces(path)
        for batch in batches:
            texts = [model.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(f"`{key}`").alias(key), F.col(f"`{ids}`").cast("array<int>")).mapInArrow(run, schema)


def digests(docs, path):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every whole text encoded and decoded again.

    One row for each row of docs, in any order; null texts count as empty, and an empty text has no ids
    and the digests of empty strings.  Nothing is shuffled and a text is held once for each task; an empty table gives
    no rows.
    """
    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(partial(_digests, path), schema)


def _digests(path, batches):
    model = pieces(path)
    number = [str(i) for i in range(len(model.bytes))]
    for batch in batches:
        for first, texts in _slices(batch):
            encoded = model.encode_all(texts)
            n = [len(ids) for ids in encoded]
            of_ids = [hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest() for ids in encoded]
            of_text = [hashlib.sha256(model.decode(ids).encode()).hexdigest() for ids in encoded]
            columns = [batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def differences(docs, path):
    """``doc_id, ids, expected, text, expected_text`` of texts on which the sentencepiece library disagrees.

    Both run over the same Arrow batch; no rows means that they agree on every text.
    """
    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, expected array<int>, text string, expected_text string"
    return rows.mapInArrow(partial(_differences, path), schema)


def _differences(path, batches):
    import sentencepiece

    model, library = pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
    names = ["doc_id", "ids", "expected", "text", "expected_text"]
    for batch in batches:
        for first, texts in _slices(batch):
            rows = []
            theirs = library.encode(texts, num_threads=1)
            for i, (ids, expected) in enumerate(zip(model.encode_all(texts), theirs, strict=True)):
                text, back = model.decode(ids), library.decode(expected)
                if ids != expected or text != back:
                    rows.append((batch.column(0)[first + i].as_py(), ids, expected, text, back))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [batch.column(0).type, *types]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
