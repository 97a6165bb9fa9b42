"""Exact and fast tokenisation of whole texts with the public BPE files.

The tokenizers library encodes; what is cached here is its answer for recurring
pieces. A text takes the cached way only if its characters and white space make
the cut at white space provably equal to the library's own cut: no two white
space characters in a row, and only ASCII, Latin-1 or Latin Extended letters.
Any other text goes to the library whole.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array


#: Letters of the safe range; each is \\p{L} in every Unicode version.
_L = "a-zA-ZÀ-ÖØ-öø-ɏ"
#: The pre-tokenisation patterns of the two vocabularies (fixed by the files' formats), for texts in the safe range.
BYTE_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
SAFE_BYTE = re.compile(r"[\n -~À-ÖØ-öø-ɏ]*")
MARKS = ".,;:!?&%$*"
SAFE_WORD = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join([i.to_bytes(4, "little") for i in ids])


def byte_safe(text: str) -> bool:
    """Whether cutting the text before its spaces and line ends is the library's own cut: no two of them in a row, none at an end."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n" in text and ("\n " in text or "\n\n" in text):
        return False
    return "<|" not in text and SAFE_BYTE.fullmatch(text) is not None


def word_safe(text: str) -> bool:
    return "<|" not in text and SAFE_WORD.fullmatch(text) is not None


FIRST = "\x01"  # marks a text's first piece; no safe text has it


def byte_cut(texts):
    """Arrow strings -> lists of pieces, each the text after one space; a line end begins a piece of its own."""
    import pyarrow.compute as pc

    marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " \n"), "")
    return pc.split_pattern(marked, " ")


def word_cut(texts):
    import pyarrow.compute as pc

    return pc.ascii_split_whitespace(pc.utf8_lower(texts))


def by_piece(texts, cut):
    """(distinct pieces, index of each piece among them, where each text's pieces begin and end)."""
    import numpy as np
    import pyarrow as pa

    lists = cut(pa.array(texts, pa.string()))
    coded = lists.values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)


def gathered(values: list[bytes], at, bounds):
    """(ids of all texts as uint32, where each text's begin and end): ``values`` are the distinct
    pieces' ids, ``at`` the piece at each place, ``bounds`` the texts' ends in ``at``."""
    import numpy as np

    flat = np.frombuffer(b"".join(values), "<u4")
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    ids, upto = ranges(flat, np.cumsum(size) - size, size, at)
    return ids, upto[bounds]


def ranges(flat, begin, size, at, block: int = 1 << 17):
    """(the ranges ``at`` of ``flat``, one after the other; where each begins and ends), made a block of ranges at a time."""
    import numpy as np

    upto = np.concatenate([[0], np.cumsum(size[at])])
    out = np.empty(upto[-1], flat.dtype)
    for a in range(0, len(at), block):
        some, to = at[a : a + block], upto[a : a + block + 1]
        from_ = np.repeat(begin[some] - to[:-1], size[some])
        from_ += np.arange(to[0], to[-1])
        out[to[0] : to[-1]] = flat[from_]
    return out, upto


def ids_of_many(texts, safe, by_pieces, whole):
    """For each text the bytes of its ids: safe texts by pieces, all at once, others whole."""
    out = [b""] * len(texts)
    own = [i for i, t in enumerate(texts) if t and safe(t)]
    if own:
        ids, ends = by_pieces([texts[i] for i in own])
        raw, ends = ids.tobytes(), (ends * 4).tolist()
        for i, a, b in zip(own, ends[:-1], ends[1:], strict=True):
            out[i] = raw[a:b]
    for i in set(range(len(texts))).difference(own):
        if texts[i]:
            out[i] = whole(texts[i])
    return out


class _Cache(dict):
    """piece -> value. A new piece is on trial; if it comes again it is kept, in two generations of
    ``limit`` pieces each. Memory is bounded, and pieces that came just once don't displace others."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old, self.trial = make, limit, {}, {}

    def forget(self) -> None:
        self.clear()
        self.old, self.trial = {}, {}

    def __missing__(self, piece):
        value = self.trial.pop(piece, None)
        if value is None:
            value = self.old.pop(piece, None)
        if value is None:
            value = self.make(piece)
            if len(self.trial) >= self.limit:
                self.trial.clear()
            self.trial[piece] = value
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class BytePieces:
    """Maps pieces of ``byte_cut`` by a cached function; ``of_token`` gets what the pattern matches.

    A piece of letters alone is one token, and with one mark at its end it is two,
    the first of which is cached as the piece without the mark.
    """

    def __init__(self, of_token, join):
        self.of_token, self.join = of_token, join
        self.tokens = _Cache(of_token, 50_000)
        self.inner = _Cache(self._inner)

    def _inner(self, piece: str):
        if piece.isalpha():  # in the safe range just the pattern's letters are
            return self.of_token(" " + piece)
        if piece[0] == FIRST:
            return self._join(piece[1:])
        return self._join(piece if piece[0] == "\n" else " " + piece)

    def _join(self, raw: str):
        tokens = self.tokens
        return self.join([tokens[t] for t in BYTE_PATTERN.findall(raw)])

    def __call__(self, piece: str):
        if piece[-1] in MARKS and (word := piece[:-1]).isalpha():
            return self.join((self.inner[word], self.tokens[piece[-1]]))
        return self.inner[piece]


class _Library:
    """A tokenizers file; ``of_token`` runs its BPE model over one pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.space, self.line_end = self.alphabet[32], self.alphabet[10]

    def encode(self, text: str) -> bytes:
        return pack(self.library.encode(text, add_special_tokens=False).ids)

    def of_token(self, token: str) -> bytes:
        if token.isascii():  # of the safe range's ASCII only the space and the line end are written otherwise
            mapped = token.replace(" ", self.space).replace("\n", self.line_end)
        else:
            mapped = token.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()


def token_cut(texts):
    """Safe, non-empty texts -> (Arrow strings that are one pre-token or some, where each text's begin and end).

    It cuts before each space and line end, after each line end, and where a letter is followed by something else:
    all are cuts of BYTE_PATTERN, whatever comes before or after. The strings share the texts' memory.
    """
    import numpy as np
    import pyarrow as pa

    texts = pa.array(texts, pa.string())
    _, bounds, raw = texts.buffers()
    bounds = np.frombuffer(bounds, np.int32)[: len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[: bounds[-1]]
    line_end, letter = data == 10, byte_letters()[data]
    cut = letter[:-1] > letter[1:]
    cut |= line_end[:-1]
    cut = np.append(True, cut)
    cut |= line_end
    cut |= data == 32
    cut[bounds[:-1]] = True
    offsets = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), raw), np.searchsorted(offsets, bounds)


def byte_letters():
    """For each byte of a safe text whether it is (part of) a letter: beyond ASCII there are letters alone."""
    import numpy as np

    return np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def string_bytes(strings):
    """(bytes of an Arrow array of strings, where each string begins and ends in them)."""
    import numpy as np

    _, bounds, raw = strings.buffers()
    bounds = np.frombuffer(bounds, np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(raw or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class ByteIds(_Library):
    """texts -> bytes of their ids (uint32, little-endian) by the tokenizers library.

    The distinct pieces of a slice are looked up at once among those known. The pre-tokens of new ones go to the
    library's BPE model ``together`` at a time, with a byte between them that no merge and no safe text has, so that
    nothing is merged across it. Of more than ``limit`` known pieces half stay: those that came again, the latest first.
    """

    AGAIN = 1 << 32

    def __init__(self, path: str, limit: int = 300_000, together: int = 64):
        import numpy as np
        import pyarrow as pa

        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = set().union(*(m if isinstance(m, str) else "".join(m) for m in model["merges"]))
        apart = [c for b, c in byte_alphabet().items() if b < 32 and b != 10 and c in model["vocab"] and c not in merged]
        plain = not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        self.apart = (apart[0], model["vocab"][apart[0]]) if apart and plain else None
        self.codes = np.array([ord(self.alphabet.get(b, chr(b))) for b in range(256)], "<u4")
        self.limit, self.together, self.turn = limit, together, 0
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.begin = self.size = self.used = np.zeros(0, np.int64)

    def _of_tokens(self, tokens):
        """(ids of all pre-tokens, how many each has)."""
        import numpy as np

        if self.apart is None:
            ids = [self.of_token(t) for t in tokens.to_pylist()]
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        symbol, end = self.apart
        data, bounds = string_bytes(tokens)
        text = np.full(len(data) + len(tokens), ord(symbol), "<u4")
        text[np.arange(len(data)) + np.repeat(np.arange(len(tokens)), np.diff(bounds))] = self.codes[data]
        text = text.tobytes().decode("utf-32-le")
        ends = bounds[1:] + np.arange(1, len(tokens) + 1)
        at = [0, *ends[self.together - 1 : -1 : self.together].tolist(), len(text)]
        ids = array("I")
        for a, b in zip(at[:-1], at[1:], strict=True):
            ids.extend([t.id for t in self.model.tokenize(text[a:b])])
        ids = np.frombuffer(ids, "<u4")
        return ids[ids != end], np.diff(np.flatnonzero(ids == end), prepend=-1) - 1

    def _of_pieces(self, pieces):
        """(ids, where each piece's begin among them, how many each has)."""
        import numpy as np
        import pyarrow as pa

        data, bounds = string_bytes(pieces)
        first = bounds[:-1]
        one = byte_letters()[data[np.where(data[first] == 32, first + 1, first)]]  # a letter at its head: letters alone
        found = [BYTE_PATTERN.findall(p) for p in pieces.filter(pa.array(~one)).to_pylist()]
        flat, n = self._of_tokens(pa.concat_arrays([pieces.filter(pa.array(one)), pa.array([t for f in found for t in f], pa.string())]))
        upto = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum([np.count_nonzero(one), *map(len, found)])
        begin, end = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        begin[one], end[one] = upto[: ends[0]], upto[1 : ends[0] + 1]
        begin[~one], end[~one] = upto[ends[:-1]], upto[ends[1:]]
        return flat, begin, end - begin

    def _safe(self, texts: list[str]):
        """(ids of all texts, where each text's begin and end)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces, bounds = token_cut(texts)
        coded = pieces.dictionary_encode()
        hit = pc.index_in(coded.dictionary, value_set=self.known)
        new = hit.is_null().to_numpy(zero_copy_only=False)
        fresh, old = coded.dictionary.filter(pa.array(new)), hit.drop_null().to_numpy()
        place = np.empty(len(new), np.int64)
        place[~new], place[new] = old, len(self.known) + np.arange(len(fresh))
        self.turn += 1
        self.used[old] = self.turn + self.AGAIN
        if len(fresh):
            flat, begin, size, upto = [self.flat], [self.begin], [self.size], len(self.flat)
            for a in range(0, len(fresh), 1 << 16):
                ids, first, n = self._of_pieces(fresh.slice(a, 1 << 16))
                flat.append(ids)
                begin.append(first + upto)
                size.append(n)
                upto += len(ids)
            self.flat, self.begin, self.size = np.concatenate(flat), np.concatenate(begin), np.concatenate(size)
            self.known = pa.concat_arrays([self.known, fresh])
            self.used = np.concatenate([self.used, np.full(len(fresh), self.turn)])
        ids, upto = ranges(self.flat, self.begin, self.size, place[coded.indices.to_numpy()])
        if len(self.known) > self.limit:
            self._keep(np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2]))
        return ids, upto[bounds]

    def _keep(self, at) -> None:
        import pyarrow as pa

        self.known, self.used = self.known.take(pa.array(at)), self.used[at]
        self.flat, upto = ranges(self.flat, self.begin, self.size, at)
        self.begin, self.size = upto[:-1], self.size[at]

    def many(self, texts: list[str | None]) -> list[bytes]:
        return ids_of_many(texts, byte_safe, self._safe, self.encode)


class WordIds(_Library):
    """The same for the lower-case vocabulary that drops white space: words are independent there."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokens = _Cache(self.of_token, 50_000)
        self.words = _Cache(self._word, 120_000)

    def forget(self) -> None:
        """Empty the caches."""
        for cache in (self.tokens, self.words):
            cache.forget()

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self.of_token(word)
        tokens = self.tokens
        return b"".join([tokens[t] for t in WORD_PATTERN.findall(word)])

    def _piece(self, piece: str) -> bytes:
        if piece[-1:] in MARKS and (word := piece[:-1]).isalpha():
            return self.words[word] + self.tokens[piece[-1]]
        return self.words[piece]

    def _safe(self, texts: list[str]):
        pieces, at, bounds = by_piece(texts, word_cut)
        return gathered([self._piece(p) for p in pieces], at, bounds)

    def many(self, texts: list[str | None]) -> list[bytes]:
        return ids_of_many(texts, word_safe, self._safe, self.encode)


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


class MergeCounter:
    """Counts the tokens of byte-level BPE without making ids.

    The symbols of a pre-token form a doubly linked list; a heap holds the
    adjacent pairs by (rank, position). The lowest pair is popped and merged,
    stale entries are skipped. Tokens = first symbols - merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        self.rank = {}
        for i, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((a, b), i)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.alphabet = byte_alphabet()
        self.pieces = BytePieces(self.count_token, sum)
        self._library = None
        self.path = path

    def symbols(self, token: str) -> list[str]:
        a = self.alphabet
        return [a[b] for b in token.encode("utf-8")]

    def count_token(self, token: str) -> int:
        return self.count_symbols(self.symbols(token))

    def count_symbols(self, sym: list[str]) -> int:
        n = len(sym)
        if n < 2:
            return n
        rank = self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue
            merges += 1
            sym[i], sym[j] = left + right, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return n - merges

    def _slow(self, text: str) -> int:
        """Texts outside the safe range: the library's pre-tokeniser cuts, the merging stays ours."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return sum(self.count_symbols(list(t)) for t, _ in self._library.pre_tokenize_str(text))

    def _whole(self, text: str) -> int:
        if self.cut is None:
            return self._slow(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self._slow(p) for p in parts if p)

    def many(self, texts: list[str | None]):
        """The number of tokens of each text."""
        import numpy as np

        out = np.zeros(len(texts), np.int64)
        own = [i for i, t in enumerate(texts) if t and byte_safe(t)]
        if own:
            pieces, at, bounds = by_piece([texts[i] for i in own], byte_cut)
            n = np.fromiter(map(self.pieces, pieces), np.int64, len(pieces))[at]
            out[own] = np.diff(np.concatenate([[0], np.cumsum(n)])[bounds])
        for i in set(range(len(texts))).difference(own):
            if texts[i]:
                out[i] = self._whole(texts[i])
        return out


_MADE: dict = {}


def made(kind, path: str):
    """One tokeniser of a kind and path for each worker process; its caches outlive the task."""
    key = (kind, path)
    if key not in _MADE:
        _MADE[key] = kind(path)
    return _MADE[key]
