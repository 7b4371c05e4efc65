"""Personal data in plain and in disguised form, at its place in the source text.

Plain identifiers are found by the base patterns. For the disguised ones a chain of
transducers rewrites the text: homoglyphs and special blanks to ASCII, letters that stand for
digits within a numeral (O, o, l, I) to these, invisible characters away, spelled digits to digits
(three words in a row, or fewer beside a numeral, a spelled dot or further digit words), "at" /
"dot" in words or brackets to the signs, also over a line end, and signs between blanks. Each
transducer keeps for every character it writes the range of source characters it came from, so
that what the same patterns find in the rewritten text is mapped back to the source. Such a
span is added when it touches no earlier added one and each base span it touches is a fragment of
it, cut off by a disguise; the fragment stays beside it.

Null text counts as empty. Each input row gives one result row, repeated rows and null ids
included; an empty table gives an empty result; further columns are ignored.
"""

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

from cashtide.llm.common import documents, in_arrow, utf8

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_TAIL = re.compile("@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile("[A-Za-z0-9._%+-]+")
# A match begins where a run of digits does, so the other places of a run are not tried.
IP = re.compile("(?<![0-9])[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)")
CARD = re.compile("[0-9](?:[\\x20-]?[0-9])+")
PHONE = re.compile("\\+[0-9][\\x20().0-9-]+[0-9]")

# Letters and signs of other scripts that look like ASCII ones.
HOMOGLYPHS = (
    str.maketrans("АВЕКМНОРСТХ", "ABEKMHOPCTX")
    | str.maketrans("асеорхуіјѕһԁɡ", "aceopxyijshdg")
    | str.maketrans("ΑΒΕΖΗΙΚΜΝΟΡΤΧ", "ABEZHIKMNOPTX")
    | str.maketrans("οιν＠＋＿", "oiv@+_")
    | dict.fromkeys(map(ord, "．﹒。․"), ".")
    | dict.fromkeys(map(ord, "－‐‑‒–—﹣"), "-")
)
HOMOGLYPHS |= dict.fromkeys(map(ord, "\u00a0\u2002\u2003\u2007\u2008\u2009\u200a\u202f\u3000"), " ")
HOMOGLYPHS |= {0xFF21 + i: chr(65 + i) for i in range(26)}
HOMOGLYPHS |= {0xFF41 + i: chr(97 + i) for i in range(26)}
for _zero in (0xFF10, 0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    HOMOGLYPHS |= {_zero + i: chr(48 + i) for i in range(10)}
INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]+")
# The digits in words.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_DIGIT = "(?:" + "|".join(DIGITS) + ")"
_BEGIN, _END = "(?<![^\\W\\d])", "(?![^\\W\\d])"
#: What digit words may stand in a row with: digit words with a leading plus where there is one,
#: numerals, spelled dots.
SPELLED = re.compile(
    f"(?i)(?P<words>(?:(?:\\bplus|\\+)[\\x20-]+)?{_BEGIN}{_DIGIT}(?:[\\x20,-]+{_DIGIT})*{_END})|[0-9]+|"
    "\\bdot\\b|[\\[({<][\\x20]*(?:dot|\\.)[\\x20]*[\\])}>]"
)
_BETWEEN = "(?:[\\x20,()-]*|\\.)"
BETWEEN = re.compile(_BETWEEN)
#: So many digit words in a row are rewritten wherever they stand.
ALONE = 3
SPELLED_WORD = re.compile(f"(?i)plus|\\+|{_DIGIT}")
# Every pattern begins at a sign, a letter or a digit, never at a blank: a long run of blanks is read
# once. The blanks before a bracket are taken in by ``bracketed``.
_GAP = "[\\x20\\t\\r\\n]"
_OPEN, _CLOSE = f"[\\[({{<]{_GAP}*", f"{_GAP}*[\\])}}>]"
AT_BRACKET = re.compile(f"(?i){_OPEN}(?:at|@){_CLOSE}{_GAP}*")
DOT_BRACKET = re.compile(f"(?i){_OPEN}(?:dot|\\.){_CLOSE}{_GAP}*")
_DOT = f"(?:{_GAP}+(?:dot|\\.){_GAP}+|{_GAP}*{_OPEN}(?:dot|\\.){_CLOSE}{_GAP}*)"
#: A bare "at" counts only in front of a host whose dots are spelled too.
AT_WORD = re.compile(f"(?i)(?<=[a-z0-9]){_GAP}+at{_GAP}+(?=[a-z0-9-]+{_DOT}[a-z0-9-])")
DOT_WORD = re.compile(f"(?i)(?<=[a-z0-9]){_GAP}+dot{_GAP}+(?=[a-z0-9])")
#: Signs between blanks; a full stop that ends a sentence has none before it.
AT_SIGN = re.compile(f"(?<=[A-Za-z0-9]){_GAP}+@{_GAP}*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@{_GAP}+(?=[A-Za-z0-9])")
DOT_SIGN = re.compile("(?<=[A-Za-z0-9])[\\x20]+\\.[\\x20]+(?=[a-z0-9])")
#: Numerals with letters that look like digits, alone or between dots.
LIKE_DIGITS = re.compile("(?<![A-Za-z0-9.])(?=[OolI.]*[0-9])[0-9OolI]+(?:\\.[0-9OolI]+)*(?![A-Za-z0-9])")
LIKE = {"O": "0", "o": "0", "l": "1", "I": "1"}
# Words after which a bare "at" is prose.
BEFORE_AT = frozenset(
    "look looks looked looking stare stared point pointed arrive arrived meet met meeting stay stayed "
    "work works worked working live lives lived sit stand stood laugh laughed shout shouted aim aimed "
    "good bad is was are were be been am me you him her it us them here there not and or up back "
    "only available hosted site page visit".split()
)
#: Kinds whose patterns run over blanks. Any other identifier is over at a blank.
SPACED = ("card", "phone")
LONG_DASH = "‒–—"
#: A text without any of these has nothing to rewrite.
DISGUISED = re.compile(
    f"[^\\x00-\\u009f\\u00a1-\\u00ac\\u00ae-\\u0250]|[0-9]\\.?[OolI]|[OolI]\\.?[0-9]|\\x20\\.\\x20|{_GAP}@|@{_GAP}|"
    f"(?i:[\\[({{<]\\s*(?:at|dot|@|\\.)\\s*[\\])}}>]|\\sdot\\s|"
    f"[0-9]{_BETWEEN}{_DIGIT}|{_BEGIN}{_DIGIT}{_BETWEEN}(?:[0-9]|{_DIGIT}))"
)

#: Letters of the longest word that is compared with those before a bare "at".
LONGEST = max(map(len, BEFORE_AT))

FOUND = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, spans string, n_added bigint, found boolean"
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text):
    """Matches of name and host. A match needs its sign, so only what stands around each sign
    is read; the name is the whole run before it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and EMAIL_NAME.fullmatch(text[begin - 1]):
            begin -= 1
        tail = EMAIL_TAIL.match(text, at) if begin < at else None
        if tail:
            found.append(("email", begin, tail.end()))
            done = tail.end()
        at = text.find("@", max(at + 1, done))
    return found


def numbers(text):
    found = []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def in_order(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def detect(text):
    """Base spans (kind, start, end) by start, then kind."""
    return in_order(emails(text) + numbers(text))


class Rewriting:
    """A text under rewriting: each character with the source range it stands for."""

    def __init__(self, text):
        self.text = text
        self.begin = range(len(text))
        self.end = range(1, len(text) + 1)

    def replace(self, find, write):
        """Rewrite every match. ``write`` gives pairs (character, from, to) within the match."""
        parts, begin, end, done = [], [], [], 0
        for m in find(self.text):
            parts.append(self.text[done : m.start()])
            begin += self.begin[done : m.start()]
            end += self.end[done : m.start()]
            for character, a, b in write(m):
                parts.append(character)
                begin.append(self.begin[m.start() + a])
                end.append(self.end[m.start() + b - 1])
            done = m.end()
        if parts or done:
            parts.append(self.text[done:])
            begin += self.begin[done:]
            end += self.end[done:]
            self.text, self.begin, self.end = "".join(parts), begin, end

    def span(self, start, end):
        return self.begin[start], self.end[end - 1]


def _sign(sign):
    return lambda m: [(sign, 0, m.end() - m.start())]


class Stretch:
    """A part of a text, as far as ``Rewriting.replace`` needs a match."""

    def __init__(self, begin, end):
        self.start, self.end = (lambda: begin), (lambda: end)


def bracketed(pattern):
    """Matches of a bracket, together with the blanks before it."""

    def find(text):
        done = 0
        for m in pattern.finditer(text):
            begin = m.start()
            while begin > done and text[begin - 1] in " \t\r\n":
                begin -= 1
            yield Stretch(begin, m.end())
            done = m.end()

    return find


def at_words(text):
    """Bare "at" behind a word that may be a name."""
    for m in AT_WORD.finditer(text):
        begin = m.start()
        while begin > 0 and m.start() - begin <= LONGEST and text[begin - 1].isalpha():
            begin -= 1
        if text[begin : m.start()].lower() not in BEFORE_AT:
            yield m


def _digits(m):
    return [(LIKE.get(c, c), i, i + 1) for i, c in enumerate(m[0])]


def spelled(text):
    """Matches of digit words: three or more in a row, fewer beside a numeral, a spelled dot or
    further digit words."""
    before, joined = None, False
    for m in SPELLED.finditer(text):
        joins = before is not None and bool(BETWEEN.fullmatch(text, before.end(), m.start()))
        if before is not None and _counts(before, joined or joins):
            yield before
        before, joined = m, joins
    if before is not None and _counts(before, joined):
        yield before


def _counts(m, joined):
    words = m["words"]
    return bool(words) and (joined or len(re.findall(_DIGIT, words.lower())) >= ALONE)


def _spelled(m):
    for w in SPELLED_WORD.finditer(m[0]):
        yield DIGITS.get(w[0].lower(), "+"), w.start(), w.end()


def normalise(text):
    """The text with its disguises undone."""
    out = Rewriting(text.translate(HOMOGLYPHS))
    out.replace(INVISIBLE.finditer, lambda m: ())
    out.replace(LIKE_DIGITS.finditer, _digits)
    out.replace(spelled, _spelled)
    out.replace(bracketed(AT_BRACKET), _sign("@"))
    out.replace(at_words, _sign("@"))
    out.replace(AT_SIGN.finditer, _sign("@"))
    out.replace(bracketed(DOT_BRACKET), _sign("."))
    out.replace(DOT_WORD.finditer, _sign("."))
    out.replace(DOT_SIGN.finditer, _sign("."))
    return out


def disguised(text, base):
    """Added spans: what the patterns find after rewriting, clear of all earlier added spans, and
    of base spans but for their own fragments."""
    if not DISGUISED.search(text):
        return []
    out = normalise(text)
    if out.text == text:
        return []
    known = sorted((s, e) for _, s, e in base)
    ends = list(accumulate((e for _, e in known), max))
    taken, added = [], []
    for kind, a, b in detect(out.text):
        start, end = out.span(a, b)
        i = bisect_left(taken, (start, end))
        clear = (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= end)
        i = bisect_left(known, (end,))
        while clear and i and ends[i - 1] > start:
            i -= 1
            if known[i][1] > start:
                same = text[start:end] == out.text[a:b]
                clear = not same and fragment(text, kind, known[i], (start, end))
        if clear:
            taken.insert(bisect_left(taken, (start, end)), (start, end))
            added.append((kind, start, end))
    return added


def fragment(text, kind, part, whole):
    """Whether a base span is only a part of a rewritten one, not a whole identifier with other
    text behind or before it.

    An address is over at a blank, and at a long dash unless further host labels follow it.
    """
    (start, end), (begin, over) = part, whole
    if not (begin <= start and end <= over) or part == whole:
        return False
    if kind in SPACED:
        return True
    if begin < start and (text[start - 1].isspace() or text[start - 1] in LONG_DASH):
        return False
    if end < over and text[end] in LONG_DASH:
        return "." in text[end:over].translate(HOMOGLYPHS)
    return end == over or not text[end].isspace()


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _find_task(batches):
    for batch in batches:
        rows = []
        for data in utf8(batch.column(1)):
            text = (data or b"").decode("utf-8", "replace")
            base = detect(text)
            added = disguised(text, base)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((*counts, digest, written(in_order(base + added)), len(added), bool(base or added)))
        names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "found")
        yield {"doc_id": batch.column(0)} | {
            name: [r[i] for r in rows] for i, name in enumerate(names)
        }


def find(docs):
    """Per document: base matches of each kind and their checksum, all spans, how many of them the
    rewriting added, and whether there is any."""
    return in_arrow(docs.select("doc_id", "text"), _find_task, FOUND)


def op8_pii_spans(spark, sf_dir):
    return find(documents(spark, sf_dir))
