"""Token ids by the tokenizers library, inside Arrow batches.

A byte-pair encoder first splits a text into words, with or without their
leading space, and runs of marks, digits and white space, and encodes each on
its own; texts repeat them. So the texts of a batch are cut where such a part
surely ends, the different parts are found by Arrow's dictionary encoding, and
the ids of the documents are put together from those of the parts with numpy.

The cuts are before a space that precedes a visible character, between an ASCII
or Latin-1 letter and an ASCII mark, and around a line end between visible
characters. Parts that are all letters or all marks go to the library's model,
other parts are encoded whole, and so is a text with a space before other white
space, or at its end, or with the string of an added token. ``tests/llm/test_tokens.py`` holds this against encoding
whole texts.

The cuts are exact for the two kinds of tokenizer used here, byte-level ones
that split letters, digits and marks, with or without lower-casing: they never
form a token of a visible character followed by white space, nor of a letter
followed by a mark, they look behind nothing, and their only look-ahead concerns
runs of white space, none of which is cut. NFC and lower-casing character by
character reach over no space and leave composed Latin-1 letters apart from
their case.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: White space, as RE2 writes it.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What no cut is made in: a space at the end or before white space, and the
#: character that marks a part without a leading space.
UNCUT = f" ($|[{SPACES}])|\x01"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
LETTERS = re.compile(f"[{LATIN}]+").fullmatch
#: ASCII marks without the apostrophe, which starts contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
CUTS = ((f"([{LATIN}])([{re.escape(MARKS)}])", "\\1 \x01\\2"),
        (f"([^{SPACES}])\n([^{SPACES}])", "\\1 \x01\n \x01\\2"))
LEAD, NONE = pa.scalar("\x01", pa.large_string()), pa.scalar("", pa.large_string())
# Byte-level tokenizers write a byte that is no visible Latin-1 character as
# the next character from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_REST = [b for b in range(256) if b not in _PLAIN]
BYTES = {b: chr(256 + i) for i, b in enumerate(_REST)}

#: Parts whose ids a worker keeps for later batches, the first that it meets
#: (frequent ones come early), and the longest kept: at most some 100 MB.
MOST_SEEN, SEEN_CHARS = 250_000, 32


class Encoder:
    """Ids of texts by the tokenizer file ``path``; ``end`` is put after each.
    Strings of added tokens, like ``<|endoftext|>``, are ordinary text, or with
    ``added`` those tokens, as in the library's plain call."""

    def __init__(self, path: str, end: int = 0, added: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        known = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.uncut = "|".join([UNCUT, *map(re.escape, known)])
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = "Lowercase" in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        # the lower-casing kind drops spaces, the other takes one into the token
        self.space = "" if self.lower else BYTES[32]
        self.model = self.tokenizer.model
        self.end = array("I", [end]).tobytes()
        self.seen: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 20_000):
            out += [array("I", e.ids).tobytes()
                    for e in self.tokenizer.encode_batch_fast(texts[i:i + 20_000], add_special_tokens=False)]
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts, of which earlier batches may have had some."""
        out = list(map(self.seen.get, parts))
        new = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(new, self._new([parts[i] for i in new])):
            out[i] = ids
            if len(parts[i]) <= SEEN_CHARS and len(self.seen) < MOST_SEEN:
                self.seen[parts[i]] = ids
        return out

    def _new(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts; one that starts with \\x01 follows no space."""
        out: list[bytes] = [b""] * len(parts)
        tokenize, space, whole = self.model.tokenize, self.space, []
        for i, p in enumerate(parts):
            lead, text = ("", p[1:]) if p[:1] == "\x01" else (space, p)
            if LETTERS(text):
                text = text.lower() if self.lower else text
                if not text.isascii():  # an ASCII letter stands for itself
                    text = text.encode().decode("latin-1").translate(BYTES)
            elif text.strip(MARKS):
                whole.append(i)
                continue
            elif not text:
                continue
            out[i] = array("I", [t.id for t in tokenize(lead + text)]).tobytes()
        texts = [parts[i][1:] if parts[i][0] == "\x01" else " " + parts[i] for i in whole]
        for i, ids in zip(whole, self._whole(texts)):
            out[i] = ids
        return out

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), the end id after each, and the
        place where each text's ids end."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = texts.fill_null("").cast(pa.large_string())
        uncut = pc.match_substring_regex(texts, self.uncut)
        odd = np.flatnonzero(uncut.to_numpy(zero_copy_only=False))
        marked = pc.if_else(uncut, NONE, texts) if len(odd) else texts
        for pattern, put in CUTS:
            marked = pc.replace_substring_regex(marked, pattern, put)
        cut = pc.split_pattern(pc.binary_join_element_wise(LEAD, marked, NONE), " ")
        del marked
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        del cut
        at, parts = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        del coded
        table = self._parts(parts)
        at[first[odd]] = len(table) + np.arange(len(odd))
        table += self._whole([texts[int(i)].as_py() for i in odd])
        table.append(self.end)
        last = np.append(first[1:], len(at))
        at = np.insert(at, last, len(table) - 1)
        # a batch has far under 2 ** 31 ids
        size = np.fromiter(map(len, table), np.int32, len(table)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        each = size[at]
        end = np.cumsum(each, dtype=np.int32)
        place = np.repeat(start[at] - end + each, each)
        place += np.arange(len(place), dtype=np.int32)
        out = np.frombuffer(b"".join(table), "<u4")[place], end[last + np.arange(n)].astype(np.int64)
        pa.default_memory_pool().release_unused()
        return out

    def batch(self, texts) -> list[np.ndarray]:
        """One uint32 array of ids, the end id included, for every text."""
        ids, ends = self.flat(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if len(ends) else []


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end: int = 0) -> Encoder:
    """The worker's encoder for a file, loaded once; its ids are those of the
    library's plain call."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end, added=True)
    return _ENCODERS[path, end]


#: Bytes of text encoded at once: enough to find parts again, few enough to
#: bound the memory of a batch of long texts.
TEXT_BYTES = 12 << 20


def runs(batches):
    """Arrow batches of (id, text) as lists of ids and arrays of texts of about
    ``TEXT_BYTES`` (a longer text is alone)."""
    ids, texts, size = [], [], 0

    def run():
        nonlocal ids, texts, size
        out = ids, pa.concat_arrays(texts)
        ids, texts, size = [], [], 0
        return out

    for b in batches:
        own, column = b.column("id").to_pylist(), b.column("text")
        start = 0
        for i, n in enumerate(pc.binary_length(column.fill_null("")).to_pylist()):
            size += n + 1
            if size >= TEXT_BYTES:
                ids += own[start:i + 1]
                texts.append(column[start:i + 1])
                yield run()
                start = i + 1
        if start < len(own):
            ids += own[start:]
            texts.append(column[start:])
    if ids:
        yield run()
