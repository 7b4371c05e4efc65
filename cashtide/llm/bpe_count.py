"""Token counts by byte-pair merging, without producing token ids.

A text is cut at ASCII white space; no token of the vocabulary crosses it, so a text's count is
the sum over its chunks, which repeat and are remembered per worker. Within a chunk, added
tokens of the file count as one, the rest is normalised and cut into words as the file
says, and each word starts as one symbol a byte. A heap of adjacent pairs ordered by (rank,
position) over a linked list of symbols yields the next merge; the count is the number of
initial symbols minus the number of merges.

Null text counts as empty: no bytes, no tokens. Repeated rows and null ids pass through, one
result row per input row; an empty table gives an empty result; further columns are ignored.
"""

import heapq
import json
import re
import unicodedata

from cashtide.llm.common import Memo, documents, in_arrow, utf8, worker_state

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Chunks remembered by one Python worker, about 200 bytes each.
REMEMBERED = 600_000


def vocabulary_path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def count_merged(symbols, ranks):
    """Symbols left after merging the lowest-ranked adjacent pair until none is known.

    ``symbols`` are numbers below 2**24 and ``ranks`` maps ``a << 24 | b`` to (rank, merged).
    Of equal ranks the leftmost pair goes first.
    """
    last = len(symbols)
    if last < 2:
        return last
    symbols = list(symbols)
    get = ranks.get
    heap = []
    for i in range(last - 1):
        found = get(symbols[i] << 24 | symbols[i + 1])
        if found:
            heap.append(found[0] << 32 | i)
    if not heap:
        return last
    heapq.heapify(heap)
    after = list(range(1, last + 1))
    before = list(range(-1, last - 1))
    pop, push = heapq.heappop, heapq.heappush
    merges = 0
    while heap:
        entry = pop(heap)
        i = entry & 0xFFFFFFFF
        j = after[i]
        if symbols[i] < 0 or j == last:
            continue
        found = get(symbols[i] << 24 | symbols[j])
        if not found or found[0] != entry >> 32:
            continue  # one of the two has been merged meanwhile
        merged = symbols[i] = found[1]
        symbols[j] = -1
        merges += 1
        k = after[i] = after[j]
        if k < last:
            before[k] = i
            found = get(merged << 24 | symbols[k])
            if found:
                push(heap, found[0] << 32 | i)
        h = before[i]
        if h >= 0:
            found = get(symbols[h] << 24 | merged)
            if found:
                push(heap, found[0] << 32 | h)
    return last - merges


def byte_letters():
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the letters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 256
    for byte in range(256):
        if byte in own:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(extra)
            extra += 1
    return letters


class Counter:
    """Counts the tokens of a white-space-free chunk for one vocabulary file.

    Chunks of Latin letters are normalised here; for others the file's own normaliser and
    word rule are asked, whose tables may be of another Unicode version than Python's.
    """

    def __init__(self, path):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        number, self.ranks = dict(model["vocab"]), {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[number[a] << 24 | number[b]] = (rank, number[a + b])
        letters, end = byte_letters(), model.get("end_of_word_suffix") or ""
        self.inner = [number[letters[b]] for b in range(256)]
        self.last = [number[letters[b] + end] for b in range(256)]
        self.byte_of = {letter: byte for byte, letter in letters.items()}
        pattern = next(
            p["pattern"]["Regex"]
            for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split"
        )
        self.words = regex.compile(pattern).findall
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.not_latin = re.compile("[^\x00-\u024f]").search
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.of_word = Memo(self._word, REMEMBERED)

    def _merged(self, data):
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return count_merged(symbols, self.ranks)

    def _word(self, word):
        return self._merged(word.encode())

    def _plain(self, text):
        if self.not_latin(text):
            words = (w for w, _ in self.cut(self.normalise(text)))
            return sum(self._merged(bytes(map(self.byte_of.__getitem__, w))) for w in words)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        of_word = self.of_word
        return sum([of_word[w] for w in self.words(text.lower())])

    def chunk(self, data):
        text = data.decode("utf-8", "replace")
        if self.added is None or "<" not in text:
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def _counting_task(vocabulary, limit):
    def task(batches):
        def make():
            return Memo(Counter(vocabulary_path(vocabulary)).chunk, REMEMBERED)

        of_chunk = worker_state(f"counts_{vocabulary}", make)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for data in utf8(batch.column(1)):
                n_bytes.append(len(data or b""))
                n_tokens.append(sum(map(of_chunk.__getitem__, (data or b"").split())))
            yield {
                "doc_id": batch.column(0),
                "n_bytes": n_bytes,
                "n_tokens": n_tokens,
                "over_limit": [n > limit for n in n_tokens],
            }

    return task


def count_tokens(docs, vocabulary=VOCABULARY, limit=LIMIT):
    """Per document: bytes, tokens, and whether the tokens exceed ``limit``."""
    return in_arrow(
        docs.select("doc_id", "text"),
        _counting_task(vocabulary, limit),
        "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )


def op3_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir))
