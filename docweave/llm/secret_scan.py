"""Secret scanning with a random forest that removes false positives.

Candidates are proposed by place alone; what they look like is left to the forest:

* runs of at least ``SHORTEST`` ASCII characters that tokens are made of, of any composition, and the runs that hold
  them together with ``!@#$%&*:^?``; of a run with an inner '=' every part;
* of any length from ``SHORTEST_VALUE``: quoted values, values after '=' or ':', the three words after a word that goes
  with secrets, passwords in addresses.  They may hold any character, those quoted after '=' or ':' blanks too.

Candidates may overlap; redaction replaces the union of those accepted.  Not proposed: bare words below ``SHORTEST``
characters that no quote, sign or word points at, and the mark of redaction itself.

A forest, trained from labelled findings, decides on length, character transitions, coverage by dictionary words, path
shape and neighbouring words.  Labelled findings are given by the caller (a bounded
sample of rows ``before, candidate, after, label``); without them a generated set of usual token formats and usual false
positives (hashes of commits, identifiers, card numbers, paths, versions, long words) is used.  The forest is some
10,000 numbers and is broadcast.

``find_secrets`` returns every candidate with its score; ``redact_secrets`` replaces those accepted in the texts.

Defined results: null and empty texts have no candidates (redaction leaves null null); repeated rows give repeated
findings; a run without an inner '=' is one candidate at any length; equal strings in equal contexts have equal scores,
and a score of exactly the threshold counts as a secret; an empty table gives an empty result.  ``find_secrets`` ignores
extra columns, ``redact_secrets`` keeps them, whatever their names.  Whole texts are read, one of any length at a time,
with some 30 bytes of work space a byte.  Offsets are in code points.  Neighbouring words are looked for in the
``CONTEXT`` bytes before a candidate and the eight after it.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, text_buffer, word_ranges
from .runtime import bounded_sample

SHORTEST = 8
SHORTEST_VALUE = 2
CONTEXT = 48
# Characters of candidates, words that go with secrets, usual starts of issued tokens, words that go with
# other tokens, a small dictionary
TOKEN_CHARACTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=.-~"
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private", "client_secret", "key", "passphrase", "passcode", "seed")
STRONG_WORDS = ("password", "passwd", "pwd", "secret", "passphrase", "passcode", "credential", "seed")
MARK = "[SECRET]"
KNOWN_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "glpat-", "npm_", "AIza", "eyJ")
OTHER_WORDS = ("sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "etag", "revision", "version", "http", "file", "path", "image", "card", "phone", "order", "build")
DICTIONARY = frozenset("about access account admin after align android apache archive article asset author backup banner before binary block branch build button cache class client cloud code column common config content control core country data date default delete design detail develop device digital directory document download element engine error event example export family feature field file filter final folder font footer format frame from function general global group handler header hello home html image import index info input install internal java language large latest layer layout left library license line link list load local location login main manager media memory menu message method middle mobile model module monitor name native network news node number object online option order output package page panel parent patch path photo plugin point policy portal post preview private process product profile program project public python query quick reader release remote report request resource response result right root sample schema screen script search section server service session setting shared simple small source spark stage standard static status storage stream string style support switch system table target template test text theme title tool track type update upload user utils value vector version video view web widget window with word work world write".split())
WORD_STARTS = frozenset(w[:4] for w in DICTIONARY)
IS_OTHER = np.ones(256, bool)
IS_OTHER[list(TOKEN_CHARACTERS)] = False
IS_OUTSIDE = IS_OTHER.copy()
IS_OUTSIDE[list(b"!@#$%&*:^?")] = False
KINDS = np.full(128, 4)
KINDS[48:58], KINDS[65:91], KINDS[97:123] = 0, 1, 2
_letters = re.compile(r"[a-z]{4,}")
_hex = re.compile(r"[0-9a-fA-F]+")
_uuid = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_neighbour = re.compile(r"[A-Za-z0-9_\-]+")
# what can give a candidate its context: see Detector.scan
POINTERS = tuple(w.encode() for w in (*SECRET_WORDS, *OTHER_WORDS) if not any(v != w and v in w for v in (*SECRET_WORDS, *OTHER_WORDS)))
IS_SIGN = np.zeros(256, bool)
IS_SIGN[list(b"=:\"'`[")] = True
_secret_word = re.compile(b"(?:" + b"|".join(re.escape(w.encode()) for w in SECRET_WORDS) + rb")[\w\-]*", re.I)
_secret_words, _other_words = (re.compile("|".join(map(re.escape, words)), re.I | re.A) for words in (SECRET_WORDS, OTHER_WORDS))
_next_words = re.compile(rb"\s*(\S+)(?:\s+(\S+))?(?:\s+(\S+))?")
_values = (
    re.compile(rb"([\"'`])((?:\\\S|(?!\1)[^\s\\])+)\1"),
    re.compile(rb"[=:]>?[ \t]*([\"'`])((?:\\.|(?!\1)[^\r\n\\])+)\1"),
    re.compile(rb"()(?<=[=:])>?[ \t]*([^\s\"'`=:]\S*)"),
    re.compile(rb"()://[^\s:/@]*:([^\s@/]+)@"),
)
OPENING, CLOSING = b"\"'`([{<=:,;", b"\"'`)]}>,;.:"


class Transitions:
    """Mean log ratio of character pairs in secrets against others."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        counts = np.full((2, 8, 8), 2.0)
        for _, s, _, y in rows:
            c = self.code(s)
            np.add.at(counts[y], (c[:-1], c[1:]), 1)
        p = counts / counts.sum((1, 2), keepdims=True)
        self.ratio = np.log(p[1] / p[0])

    @staticmethod
    def code(s: str) -> np.ndarray:
        return Transitions.code_of(np.frombuffer(s.encode("ascii", "replace"), np.uint8).astype(np.int64))

    @staticmethod
    def code_of(b: np.ndarray) -> np.ndarray:
        kind = KINDS[b]
        vowel = np.isin(b | 32, np.frombuffer(b"aeiou", np.uint8))
        hexa = np.isin(b | 32, np.frombuffer(b"bcdf", np.uint8))
        return np.where(kind == 0, 0, np.where(kind == 4, 7, np.where(kind == 1, 1, 3) + np.where(vowel, 0, np.where(hexa, 1, 3 - (kind == 1)))))


def coverage(s: str) -> float:
    """Share of characters in dictionary words, longest first from the left."""
    covered = 0
    for m in _letters.finditer(s.lower()):
        run, a = m.group(), 0
        while a < len(run) - 3:
            if run[a : a + 4] not in WORD_STARTS:
                a += 1
                continue
            n = next((n for n in range(min(10, len(run) - a), 3, -1) if run[a : a + n] in DICTIONARY), 0)
            covered += n
            a += n or 1
    return covered / len(s)


def shapes(strings: list[str], transitions: Transitions) -> np.ndarray:
    """A row of what each string's characters tell; strings hold no line feed."""
    joined = "\n".join(strings) + "\n"
    c = np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), 127).astype(np.int64)
    stop = np.flatnonzero(c == 10)
    first = np.concatenate([[0], stop[:-1] + 1])
    n = (stop - first).astype(float)
    row = np.repeat(np.arange(len(n)), stop - first + 1)
    inside = c != 10
    kinds = KINDS[c]
    low = np.where(kinds == 1, c + 32, c)
    letter = (kinds == 1) | (kinds == 2)
    vowel = np.isin(low, np.frombuffer(b"aeiou", np.uint8))
    per = lambda mask: np.add.reduceat(mask.astype(float), first)
    count = lambda chars: per(np.isin(c, np.frombuffer(chars, np.uint8)))
    pairs = inside[:-1] & inside[1:]
    many = np.maximum(n - 1, 1)
    code = transitions.code_of(c)
    ratio = np.append(np.where(pairs, transitions.ratio[code[:-1], code[1:]], 0), 0)
    change = np.append(pairs & (kinds[:-1] != kinds[1:]), False)
    seen = np.bincount((row * 128 + c)[inside], minlength=len(n) * 128).reshape(-1, 128) / n[:, None]
    entropy = -(seen * np.log2(np.where(seen > 0, seen, 1))).sum(1)
    soft = ~(letter & ~vowel & (low != 121))
    place = np.arange(len(c))
    run = place - np.maximum.accumulate(np.where(soft, place, -1))

    def having(pattern):
        flag = np.zeros(len(n))
        flag[np.searchsorted(stop, [m.start() for m in pattern.finditer(joined)])] = 1
        return flag

    hexa = count(b"0123456789abcdefABCDEF=.-") == n
    dots = count(b".")
    ends = [0.0] * len(n)
    for k in np.flatnonzero(dots > 0).tolist():
        ends[k] = float(bool(re.search(r"\.[a-z]{2,5}$", strings[k])))
    is_hex, is_uuid, mail = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for k in np.flatnonzero(hexa).tolist():
        is_hex[k], is_uuid[k] = bool(_hex.fullmatch(strings[k].strip("=.-"))), bool(_uuid.fullmatch(strings[k]))
    for k in np.flatnonzero(count(b"@") > 0).tolist():
        mail[k] = bool(re.search(r"@[\w\-]+(\.[\w\-]+)+$", strings[k]))
    return np.stack([
        n, np.log(n), per(ratio) / many, per(change) / many, entropy, np.array([coverage(s) for s in strings]), count(b"/") / n, dots, ends,
        per(kinds == 0) / n, per(kinds == 1) / n, is_hex, is_uuid, np.array([s.startswith(KNOWN_STARTS) for s in strings]), having(_secret_words), having(_other_words),
        (per(kinds == 4) - 1) / n, count(b"!@#$%&*^?") / n, per(vowel) / np.maximum(per(letter), 1), np.maximum.reduceat(run, first), np.maximum.reduce([count(bytes([x])) for x in b"-_. "]), count(b"\x7f") > 0, mail, np.isin(c[first], np.frombuffer(b"[<{$*", np.uint8)),
        np.array([s.startswith("www.") for s in strings]),
    ], axis=1).astype(float)


def context(before: str, after: str) -> tuple[bool, ...]:
    """Whether an address, a secret's word, a strong one, another word, a sign points at a candidate, and quotes hold it."""
    low = before.replace(MARK, "x").lower()
    near = " ".join(_neighbour.findall(low)[-3:])
    mark = before.rstrip(" \t\"'`>")[-1:]
    return (
        near.endswith("http") or low.endswith("://"), any(w in near for w in SECRET_WORDS), any(w in near for w in STRONG_WORDS), any(w in near for w in OTHER_WORDS),
        mark in "=:" and mark != "", before != "" and before[-1:] in "\"'`" and after[:1] in "\"'`",
    )


def features(before: str, s: str, after: str, transitions: Transitions) -> list[float]:
    return table_of([s], [context(before, after)], transitions)[0].tolist()


def table_of(strings: list[str], contexts: list[tuple[bool, ...]], transitions: Transitions) -> np.ndarray:
    x, where = shapes(strings, transitions), np.array(contexts, float)
    # rounded, as sums may differ in their last bits from batch to batch
    return np.round(np.column_stack([x[:, :-1], np.maximum(x[:, -1], where[:, 0]), where[:, 1:]]), 6)


class Forest:
    """Bagged trees on random feature subsets, split by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 31, depth: int = 9, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], depth, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x, y, depth, rng, nodes) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, float(y.mean())])
        if depth == 0 or len(y) < 4 or y.min() == y.max():
            return me
        best = None
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, cum = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            left, total = cum[cut - 1], cum[-1]
            a, b = left / cut, (total - left) / (len(y) - cut)
            impurity = cut * a * (1 - a) + (len(y) - cut) * b * (1 - b)
            k = int(np.argmin(impurity))
            if best is None or impurity[k] < best[0]:
                middle = (v[cut[k]] + v[cut[k] - 1]) / 2
                best = (impurity[k], int(f), middle if middle < v[cut[k]] else v[cut[k] - 1])
        if best is None:
            return me
        left = x[:, best[1]] <= best[2]
        nodes[me][:2] = best[1:]
        nodes[me][2] = self._grow(x[left], y[left], depth - 1, rng, nodes)
        nodes[me][3] = self._grow(x[~left], y[~left], depth - 1, rng, nodes)
        return me

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            feature, right, left = t[:, 0].astype(np.int64), t[:, 3].astype(np.int64), t[:, 2].astype(np.int64)
            at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(rows):
                here = at[rows]
                f = feature[here]
                rows, here, f = rows[f >= 0], here[f >= 0], f[f >= 0]
                at[rows] = np.where(x[rows, f] > t[here, 1], right[here], left[here])
            total += t[at, 4]
        return total / len(self.trees)


def generated_findings(count: int = 15000, seed: int = 17) -> list[tuple[str, str, str, int]]:
    """Labelled findings of usual formats, for callers that have none of their own."""
    rng = np.random.Generator(np.random.PCG64(seed))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    one = lambda items: items[int(rng.integers(len(items)))]
    words = sorted(DICTIONARY)
    syllable = lambda: pick("bcdfghlmnprstvw", 1) + pick("aeiou", 1) + pick("nrstl", 1)
    plain = lambda: " ".join("".join(syllable() for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 5))))
    names = ["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "Authorization: Bearer", "passwd", "private_key", "key", "TOKEN", "API_KEY"]
    strong = ["password", "Password", "passwd", "pwd", "secret", "client_secret", "passphrase", "db_password", "PASSWORD", "seed", "my secret", "user credential"]
    signs = "!@#$%&*"
    mixed = lambda n: "".join(rng.permutation(list(pick(low, 1) + pick(up, 1) + pick(dig, 1) + pick(low + up + dig, n - 3))))
    heads, hearts, ends = "b c d f g h j k l m n p r s t v w y z th wh st str sh ch br pr tr gr sch qu ph sp cl".split() + [""] * 6, "a e i o u a e i o ea ou io ie ai é ó ü".split() + [""] * 3, "n r s t l d m nd ng th st rs ll ght nts tch ks nt ble tion nth ndst".split() + [""] * 8
    full = lambda: one(heads) + one(hearts) + one(ends)
    spoken = lambda: "".join(one([syllable, full, full])() for _ in range(int(rng.integers(1, 5))))
    prose = lambda: "".join(full() for _ in range(int(rng.integers(2, 9))))
    shown = lambda w: one([w, w.capitalize(), w.upper(), w])
    password = lambda: one([
        lambda: mixed(int(rng.integers(8, 12))), lambda: mixed(int(rng.integers(6, 17))),
        lambda: "".join(rng.permutation(list(mixed(int(rng.integers(5, 15))) + pick(signs, int(rng.integers(1, 5)))))),
        lambda: one([one(words), spoken()]).capitalize() + pick(dig, int(rng.integers(2, 5))) + pick(signs, int(rng.integers(0, 3))),
        lambda: one([one(words), spoken()]) + pick(dig, int(rng.integers(1, 5))),
        lambda: one(words).translate(str.maketrans("aosei", "@0$31")) + pick(dig + signs, int(rng.integers(2, 5))),
    ])()
    letters_only = lambda: pick(one([low, up, low, up, up + "234567"]), int(one([16, 24, 26, 32, int(rng.integers(10, 40))])))
    phrase = lambda: one(["-", "-", "_", "."]).join(one([one(words), spoken() + syllable()]) for _ in range(int(rng.integers(4, 7))))
    rows = []
    for i in range(count):
        if i % 6 == 1:
            q = one(['"', "'", "", '"'])
            sign = one([" = ", "=", ": ", ":", " := ", '": ' if q else "="])
            kind = int(rng.integers(10))
            if kind < 5:
                body, name = password(), one(strong + names)
                if not q and rng.random() < 0.3:
                    sign = one([" is ", " ", " was "])
            elif kind < 8:
                body, name = letters_only(), one(strong + names)
                if rng.random() < 0.3:
                    rows.append((f"{plain()} ", pick(one([up, low]), int(rng.integers(20, 40))), f" {plain()}", 1))
                    continue
            elif kind < 9:
                body, name, sign = phrase(), one(strong), sign
                if q and rng.random() < 0.3:
                    body = " ".join(one(words) for _ in range(int(rng.integers(4, 7))))
            else:
                rows.append((f"{plain()} ", "".join(rng.permutation(list(mixed(int(rng.integers(9, 15))) + pick(signs, int(rng.integers(2, 5)))))), f" {plain()}", 1))
                continue
            rows.append((f"{plain()} {name}{sign}{q}", body, f"{q} {plain()}", 1))
        elif i % 6 in (0, 2, 4):
            q = one(['"', "'", ""])
            sign = one([" = ", "=", ": ", ":"])
            word = lambda: shown(one([one(words), spoken(), spoken() + syllable()]))
            mail = lambda: f"{one([one(words), spoken()])}{one(['.', '', '_'])}{pick(dig, int(rng.integers(0, 4)))}@{one([one(words), spoken()])}{pick(dig, int(rng.integers(0, 2)))}.{one(['com', 'org', 'example.com', 'de'])}"
            before, body, after = one([
                *[lambda: (" ", shown(prose()) + one(["", "", "", "!", "###", "-" + prose()]), one([" ", ". ", ", "]))] * 8,
                lambda: (" ", one([spoken() + syllable() + syllable(), one(words) + spoken(), one(words)]), one([" ", ". ", ", ", "! "])),
                lambda: (" ", shown(spoken() + syllable() + spoken()) + one(["", "!", "!!!", "###", "%%%", "$$$", "&&&", "?", "***", "@@@"]), " "),
                lambda: (" ", one(["", "#"]) + shown(spoken() + syllable()) + one(["-", "/", "&", ":", "_", "."]) + shown(spoken()), " "),
                lambda: (one([" ", ": ", "mail ", "=", ' "']), mail(), " "),
                lambda: (one([" ", ": ", "at ", "id=", "tel "]), one([":".join(pick(dig, 2) for _ in range(3)), pick(dig, 1) + "." + pick(dig, 2) + "%", "$" + pick(dig, 4), pick(dig, 3) + "-" + pick(dig, 4), pick(dig, int(rng.integers(2, 12))), "-".join(pick(dig, n) for n in (4, 2, 2)), "+" + pick(dig, 2) + "-" + pick(dig, 3) + "-" + pick(dig, 7)]), " "),
                lambda: (f" {one(['name', 'title', 'lang', 'type', 'class', 'note', 'subject', 'width', spoken(), one(words)])}{sign}{q}", one([word(), word() + "-" + word(), pick(dig, 2) + "px", word() + pick(dig, 1), " ".join(word() for _ in range(3))] if q else [word(), word() + "-" + word(), pick(dig, 2) + "px", word() + pick(dig, 1)]), q + " "),
                *[lambda: (f" {one(['', spoken()])} {q or chr(34)}", one([word(), prose()]) + one(["", "!", "?", "-" + word()]), (q or '"') + " ")] * 2,
                lambda: (f" {one(strong + names)}{one([sign, ' ', ' is ', ' '])}{q}", one(["required", "true", "false", "none", "None", "null", "string", "optional", "value", "[SECRET]", "<password>", "****", "********", "${TOKEN}", "{{ token }}", "xxxx", "is", "=", "the", "12", "30"]), q + " "),
                lambda: (f" {one(strong + names)} {one(['', '', 'is ', spoken() + ' ', spoken() + ' ' + spoken() + ' '])}", one([word(), prose(), word() + one([",", "!", "###", "%%%"])]), " "),
                lambda: (f" {one(strong + names)}{sign}{q}{one([mixed(9), pick(hexa, 40), MARK])}{q} {one(['', spoken() + ' '])}", one([word(), prose()]) + one(["", "", "!", "###"]), " "),
                lambda: (f" {one(strong + names)}{sign}{q}", word(), q + " "),
                lambda: (" ", f"https://{spoken()}.com/{one(words)}?{one(words)}={pick(dig, 2)}&{one(words)}={one(words)}", " "),
                lambda: (" ", one(["", "the-"]) + "-".join(one([one(words), spoken()]) for _ in range(int(rng.integers(3, 6)))), " "),
            ])()
            rows.append((f"{plain()}{before}", body, f"{after}{plain()}", 0))
        elif i % 6 == 3:
            body = one([lambda: pick(hexa, int(rng.integers(16, 65))), lambda: pick(hexa, one([32, 40, 64])), lambda: pick(low + up + dig, int(rng.integers(20, 48))), lambda: pick(low + up + dig + "+/", 43) + "=", lambda: one(["AKIA", "ASIA"]) + pick(up + dig, 16), lambda: one(["ghp_", "gho_", "xoxb-", "sk_live_", "glpat-", "npm_"]) + pick(low + up + dig, 36), lambda: "eyJ" + ".".join(pick(low + up + dig + "_-", n) for n in (36, 60, 43)), lambda: pick(up + dig, 40)])()
            q = one(['"', "'", "", '"'])
            if body.startswith(KNOWN_STARTS) and rng.random() < 0.6:
                rows.append((f"{plain()} ", body, f" {plain()}", 1))
                continue
            rows.append((f"{plain()} {one(names)}{one([' = ', '=', ': ', ' := ', ':'])}{q}", body, f"{q} {plain()}", 1))
        else:
            before, body = one([
                lambda: (one(["commit ", "sha1: ", "md5 checksum ", "digest sha256:", "revision "]), pick(hexa, one([32, 40, 64]))),
                lambda: (one(["id ", "uuid: ", "guid=", ""]), "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12))),
                lambda: (one(["card ", "", "order number ", "phone "]), pick(dig, one([16, 17, 19, 20]))),
                lambda: (one(["", "path ", "https://", "see ", "src="]), "/".join(one(words) for _ in range(int(rng.integers(2, 5)))) + one([".html", ".png", ".py", "/", "", "/2019"])),
                lambda: (one(["version ", "", "build "]), f"{one(words)}-{one(words)}-{pick(dig, 1)}.{pick(dig, 2)}.{pick(dig, 1)}"),
                lambda: (one(["", "the "]), one(words).capitalize() + one(words).capitalize() + one(words).capitalize() + one(["", pick(dig, 2)])),
                lambda: (one(["mail ", "", "to "]), f"{one(words)}.{pick(dig, 2)}" if rng.random() < 0.3 else f"mail{pick(dig, 2)}.example.com"),
                lambda: ("", f"{pick('12', 1)}{pick(dig, 3)}-{pick('01', 1)}{pick(dig, 1)}-{pick('012', 1)}{pick(dig, 1)}T{pick(dig, 2)}.{pick(dig, 2)}.{pick(dig, 2)}"),
                lambda: ("", "".join(syllable() for _ in range(int(rng.integers(5, 9)))) + one(["", ".", "-", pick(dig, 1)])),
                lambda: (one(names) + " ", "-".join(one(words) for _ in range(int(rng.integers(3, 6))))),
                lambda: (one(["etag ", "hash "]), pick(low + up + dig, 24)),
            ])()
            rows.append((f"{plain()} {before}", body, f" {plain()}", 0))
    return [r for r in rows if len(r[1]) >= SHORTEST_VALUE]


NOWHERE = context("", "")
KNOWN = 500000


class Detector:
    def __init__(self, findings: list[tuple[str, str, str, int]]):
        self.transitions = Transitions(findings)
        # by string, or string and context where it has one
        self.known: dict[object, float] = {}
        x = table_of([s.replace("\n", " ") for _, s, _, _ in findings], [context(b, a) for b, _, a, _ in findings], self.transitions)
        self.forest = Forest(x, np.array([f[3] for f in findings], np.float64))

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text number, first byte, byte after the last, score) of each candidate, in order; they may overlap."""
        raw = buf.tobytes()
        points = np.zeros(len(buf) + 1, np.int64)
        points[1:] = IS_SIGN[buf]
        low = raw.lower()
        for word in POINTERS:
            k = low.find(word)
            while k >= 0:
                points[k + 1] = 1
                k = low.find(word, k + 1)
        points = np.cumsum(points)
        texts = offs.tolist()
        # by first byte << 32 | byte after the last
        scored: dict[int, object] = {}
        spans: set[int] = set()
        narrow = np.full(len(buf) + 1, -1)
        for separators in (IS_OTHER, IS_OUTSIDE):
            starts, ends, _ = word_ranges(buf, offs, separators)
            good = np.flatnonzero((ends - starts >= SHORTEST) & (narrow[starts] != ends))
            narrow[starts] = ends
            a, b = starts[good], ends[good]
            # no sign, quote or word that matters in reach: such candidates differ by their characters alone
            bare = points[b] == points[np.maximum(a - CONTEXT - 16, 0)]
            for p, q, alone in zip(a.tolist(), b.tolist(), bare.tolist()):
                if alone and raw[p] not in b"./-:?" and raw[q - 1] not in b"./-:?":
                    scored[p << 32 | q] = raw[p:q]
                    continue
                for p, q in self._parts(raw, p, q):
                    if q - p >= SHORTEST:
                        if alone:
                            scored[p << 32 | q] = raw[p:q]
                        else:
                            spans.add(p << 32 | q)
        mark = MARK.encode()
        for i in np.flatnonzero(points[offs[1:]] > points[offs[:-1]]).tolist():
            lo, hi = texts[i], texts[i + 1]
            for p, q in self._pointed(raw[lo:hi]):
                spans.add(lo + p << 32 | lo + q)
        places = np.array(sorted(spans - scored.keys() if spans else ()), np.int64)
        for i, span in zip((np.searchsorted(offs, places >> 32, "right") - 1).tolist(), places.tolist()):
            p, q = span >> 32, span & 0xFFFFFFFF
            if raw[p:q] in mark and raw[max(p - 1, texts[i]) : q + 1] in mark:
                continue
            lo, hi = max(texts[i], p - CONTEXT), min(texts[i + 1], q + 8)
            where = context(raw[lo:p].decode("utf-8", "ignore"), raw[q:hi].decode("utf-8", "ignore"))
            scored[span] = raw[p:q] if where == NOWHERE else (raw[p:q], where)
        if not scored:
            return []
        known = self.known
        self._score({v for v in scored.values() if v not in known})
        order = sorted(scored)
        places = np.array(order, np.int64)
        out = list(zip((np.searchsorted(offs, places >> 32, "right") - 1).tolist(), (places >> 32).tolist(), (places & 0xFFFFFFFF).tolist(), [known[scored[k]] for k in order]))
        if len(self.known) > KNOWN:
            self.known.clear()
        return out

    def _score(self, new: set) -> None:
        """Equal strings in equal contexts have equal features, so each is scored once."""
        if not new:
            return
        new = list(new)
        pairs = [(v, NOWHERE) if isinstance(v, bytes) else v for v in new]
        x = table_of([s.decode("utf-8", "replace") for s, _ in pairs], [w for _, w in pairs], self.transitions)
        self.known.update(zip(new, self.forest.scores(x).tolist()))

    @staticmethod
    def _parts(raw: bytes, a: int, b: int):
        """The parts of a run between inner '='; padding stays with the last one."""
        end = b
        while end > a and raw[end - 1] == 61:
            end -= 1
        while True:
            cut = raw.find(b"=", a, end)
            q = b if cut < 0 else cut
            p = a
            while p < q and raw[p] in b"./-:?":
                p += 1
            while q > p and raw[q - 1] in b"./-:?":
                q -= 1
            if q > p:
                yield p, q
            if cut < 0:
                return
            a = cut + 1

    @staticmethod
    def _pointed(text: bytes):
        """Values in quotes, after signs and after words that go with secrets."""
        found, quoted = set(), set()
        for pattern in _values:
            for m in pattern.finditer(text):
                (quoted if m[1] else found).add(m.span(2))
        for m in _secret_word.finditer(text):
            after = _next_words.match(text, m.end())
            for k in (1, 2, 3) if after else ():
                if after[k]:
                    found.add(after.span(k))
        for p, q in found:
            while p < q and text[p] in OPENING:
                p += 1
            while q > p and text[q - 1] in CLOSING:
                q -= 1
            quoted.add((p, q))
        return [(p, q) for p, q in quoted if q - p >= SHORTEST_VALUE]


@functools.cache
def _supplied() -> Detector:
    return Detector(generated_findings())


def _detector(docs: DataFrame, findings: DataFrame | None, limit: int):
    detector = None
    if findings is not None:
        own = findings.select("before", "candidate", "after", "label").where("candidate is not null and length(candidate) > 1 and label in (0, 1)")
        picked = bounded_sample(own, ["before", "candidate", "after", "label"], limit, own.count()).collect()
        if picked:
            detector = Detector([(r["before"] or "", r["candidate"], r["after"] or "", int(r["label"])) for r in picked])
    return docs.sparkSession.sparkContext.broadcast(detector or _supplied())


def labelled_findings(docs: DataFrame, judged: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings to learn from (before, candidate, after, label) for judged places (id, start, n_chars, label) of the texts.

    These are rows of ``find_secrets`` with a label of 0 or 1; null labels and places outside of the text are left out.
    """
    at, n, t = F.col("start"), F.col("n_chars"), F.col(text_col)
    places = judged.where("label in (0, 1) and start >= 0 and n_chars > 0").select(id_col, "start", "n_chars", F.col("label").cast("int").alias("label"))
    joined = places.join(docs.select(id_col, text_col), id_col).where(at + n <= F.length(t))
    before = F.substring(t, F.greatest(at - CONTEXT, F.lit(0)).cast("int") + 1, F.least(at, F.lit(CONTEXT)).cast("int"))
    return joined.select(before.alias("before"), F.substring(t, (at + 1).cast("int"), n.cast("int")).alias("candidate"), F.substring(t, (at + n + 1).cast("int"), F.lit(8)).alias("after"), "label")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None, limit: int = 20000, threshold: float = 0.5) -> DataFrame:
    """(id, start, n_chars, candidate_sha256, score, is_secret) for each candidate in the texts."""
    detector = _detector(docs, findings, limit)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, _, buf, offs in chunks(*text_buffer(batch.column(1))):
                found = detector.value.scan(buf, offs)
                if not found:
                    continue
                letters = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                i, s, e, p = (np.array(c) for c in zip(*found))
                raw = buf.tobytes()
                digests = [hashlib.sha256(raw[x:y]).hexdigest() for _, x, y, _ in found]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + i)), pa.array(letters[s] - letters[offs[i]], pa.int64()), pa.array(letters[e] - letters[s], pa.int64()), pa.array(digests), pa.array(p), pa.array(p >= threshold)], names=[id_col, "start", "n_chars", "candidate_sha256", "score", "is_secret"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, start long, n_chars long, candidate_sha256 string, score double, is_secret boolean")


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = "n_chars", findings: DataFrame | None = None, limit: int = 20000, threshold: float = 0.5) -> DataFrame:
    """docs with accepted secrets replaced by ``mark``; length_col, if there is one, follows the new text."""
    detector = _detector(docs, findings, limit)
    place = docs.schema.fieldNames().index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place)
            changed = {}
            for a, _, buf, offs in chunks(*text_buffer(texts)):
                spans: dict[int, list[list[int]]] = {}
                for i, s, e, p in detector.value.scan(buf, offs):
                    if p >= threshold:
                        own = spans.setdefault(i, [])
                        if own and s < own[-1][1]:
                            own[-1][1] = max(own[-1][1], e)
                        else:
                            own.append([s, e])
                for i, own in spans.items():
                    cuts = [offs[i], *(x for span in own for x in span), offs[i + 1]]
                    changed[a + i] = mark.encode().join(buf[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2]))
            if changed:
                new = texts.to_pylist()
                for i, t in changed.items():
                    new[i] = t.decode("utf-8", "surrogatepass")
                columns = list(batch.columns)
                columns[place] = pa.array(new, texts.type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return out
