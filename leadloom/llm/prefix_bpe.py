"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece the encoding ends in one certain token. Candidates are the tokens
that are suffixes of the prefix; an automaton over all tokens lists them at each place. A
candidate is the last token if it fits after the last token of the prefix before it: two tokens
fit when encoding their joined symbols gives just these two again. Exactly one fits. Following
the lengths back from the end of the piece gives the ids. Fits are remembered by pair.

Pieces repeat, so their results are remembered per process up to a fixed number; memory does not
grow with the input. Decoding joins the tokens of the ids with one space, as the library does for
a file that names no decoder.

Defined cases: a NULL or empty text has no ids. A special string in a text is its one id, as the
library's default has it. Repeated rows are encoded one by one; other columns are not read.
"""

import hashlib
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadloom.llm.merge_count import merges
from leadloom.llm.tables import texts
from leadloom.llm.vocabulary import Memory, bare_units, strings, vocabulary, word_pieces

VOCABULARY = "word_bpe_49k.json"


class Encoder:
    """Encodes and decodes texts with one vocabulary file that marks word ends."""

    def __init__(self, path):
        self.vocabulary = v = vocabulary(path)
        # One character per symbol, so that an end mark takes no room of its own.
        spelled = {}
        for byte in range(256):
            spelled[v.bytes[byte]] = chr(byte)
            spelled[v.last_bytes[byte]] = chr(byte + 256 * bool(v.end))
        self.symbol = {text: token for token, text in spelled.items()}
        for pair, rank in sorted(v.ranks.items(), key=lambda item: item[1]):
            spelled.setdefault(v.made[rank], spelled[pair >> 32] + spelled[pair & 0xFFFFFFFF])
        self.spelled = spelled
        self.automaton = ahocorasick.Automaton()
        for token, text in spelled.items():
            self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()
        rank_of = {token: rank for rank, token in enumerate(v.made)}
        halves = {v.made[rank]: (pair >> 32, pair & 0xFFFFFFFF) for pair, rank in v.ranks.items()}
        self.rank = {token: rank_of.get(token, -1) for token in spelled}
        self.left = {token: half for token, (half, _) in halves.items()}
        self.right = {token: half for token, (_, half) in halves.items()}
        self.alone = {}
        self.fits = {}
        # Remembered ids are kept as text, one character per id.
        self.pieces = Memory(lambda piece: "".join(map(chr, self.piece(piece))), 1 << 19)
        self.units = Memory(self._unit, 1 << 19)
        size = max(v.tokens) + 1
        self.decimals = Spelling(str(i) for i in range(size))
        self.shown = Spelling(v.tokens.get(i, "") for i in range(size))

    def _alone(self, token):
        """True if encoding a token's own symbols gives the token."""
        symbols = [self.symbol[c] for c in self.spelled[token]]
        found = self.alone[token] = merges(symbols, self.vocabulary.ranks, self.vocabulary.made) == len(symbols) - 1
        return found

    def _fit(self, left, right):
        """True if no merge ever crosses the border between two tokens.

        The two are taken apart at the border, the half merged last first. A pair that meets
        there would have been merged across if its rank comes before that merge; of equal ranks
        the one further left comes first.
        """
        key, bound, rank, ranks = left << 32 | right, len(self.vocabulary.made), self.rank, self.vocabulary.ranks
        while True:
            if ranks.get(left << 32 | right, bound) < bound:
                found = False
                break
            if rank[left] > rank[right]:
                bound, left = rank[left], self.right[left]
            elif rank[right] >= 0:
                bound, right = rank[right] + 1, self.left[right]
            else:
                found = True
                break
        if len(self.fits) >= 1 << 18:
            self.fits.clear()
        self.fits[key] = found
        return found

    def piece(self, piece):
        """The ids of one piece."""
        raw = piece.encode()
        text = raw.decode("latin-1")
        if self.vocabulary.end:
            text = text[:-1] + chr(raw[-1] + 256)
        last, lengths, done = [0] * len(text), [0] * len(text), -1
        alone, fits = self.alone.get, self.fits.get
        for end, (token, length) in self.automaton.iter(text):
            if end == done:
                continue
            before = end - length
            if before < 0:
                good = alone(token)
                if good is None:
                    good = self._alone(token)
            elif lengths[before]:
                left = last[before]
                good = fits(left << 32 | token)
                if good is None:
                    good = self._fit(left, token)
            else:
                continue
            if good:
                last[end], lengths[end], done = token, length, end
        ids, end = [], len(text) - 1
        while end >= 0:
            if not lengths[end]:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
            ids.append(last[end])
            end -= lengths[end]
        return ids[::-1]

    def _unit(self, unit):
        if unit.isascii():
            lowered = unit.lower()
            if unit.isalpha():
                return self.pieces[lowered]
        else:
            unit = unicodedata.normalize("NFC", unit)
            # Letter by letter where a word's end would matter to str.lower.
            lowered = "".join(c.lower() for c in unit) if "Σ" in unit else unit.lower()
        return "".join(map(self.pieces.__getitem__, word_pieces(lowered)))

    def _plain(self, text):
        return "".join(map(self.units.__getitem__, bare_units(text)))

    def _text(self, text):
        special = self.vocabulary.special
        if any(s in text for s in special):
            parts = self.vocabulary.special_cut.split(text)
            return "".join(chr(special[part]) if part in special else self._plain(part) for part in parts)
        return self._plain(text)

    def encode(self, texts):
        """(ids, bounds): the ids of all texts in a row, and where each text's begin and end."""
        found = list(map(self._text, texts))
        ids = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4")
        return ids, np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))

    def decode(self, ids, bounds):
        """The text of each run of ids, in UTF-8."""
        return self.shown(ids, bounds)


class Spelling:
    """Texts by number, joined with one space for runs of numbers."""

    def __init__(self, texts):
        spelled = [text.encode() + b" " for text in texts]
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, ids, bounds):
        lengths = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        shift = self.starts[ids] - ends[:-1]
        out = self.flat[np.arange(ends[-1]) + np.repeat(shift, lengths)].tobytes()
        places = ends[bounds].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip(places[:-1], places[1:])]


@lru_cache(maxsize=None)
def encoder(path):
    return Encoder(path)


def _encoded(path, names):
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for first, part in strings(batch.column("text"), 1 << 20):
                ids, bounds = code.encode(part)
                decoded = code.decode(ids, bounds)
                columns = {
                    "doc_id": lambda: batch.column("doc_id").slice(first, len(part)),
                    "n_tokens": lambda: pa.array(np.diff(bounds), pa.int64()),
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))),
                    "decoded": lambda: pa.array(decoded, pa.binary()).cast(pa.string()),
                    "ids_sha256": lambda: pa.array(list(map(digest, code.decimals(ids, bounds))), pa.string()),
                    "decoded_sha256": lambda: pa.array(list(map(digest, decoded)), pa.string()),
                }
                yield pa.RecordBatch.from_pydict({name: columns[name]() for name in names})

    return run


KINDS = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path=VOCABULARY, columns=("doc_id", "n_tokens", "ids", "decoded")) -> DataFrame:
    """The named columns of ``KINDS`` for each row: ids, the text they decode to, or digests of them."""
    return texts(docs).mapInArrow(_encoded(path, columns), ", ".join(f"{c} {KINDS[c]}" for c in columns))


def digests(docs: DataFrame, path=VOCABULARY) -> DataFrame:
    """The round trip with the ids and the decoded text as SHA-256, made where they are."""
    return encode(docs, path, ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
