"""Personal data by a skip-chain conditional random field (operator 8).

Nodes are the tokens of a document that can be part of an entity: those with a digit or an at sign, numbers
written with spaces, capitalised words in sequence, and names behind a form of address or another cue
together with every repetition of them. All other words are the label `O` by definition. Potentials are
- of each node, by the shape of the token, checksums, the words before it, and the same of the run of numbers or
  the sequence of capitalised words that it belongs to,
- of neighbours in the text (the chain), and
- of equal or similar tokens at any distance (skip edges between successive mentions),
with weights trained here by pseudo-likelihood on generated text. Loopy belief propagation over all
documents of a batch at once gives each node's label; repeated mentions so agree across a document.
Entities are replaced by their kind in angle brackets.
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillion.llm import _columns, _vec

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "SSN", "IBAN", "PERSON")
ROUNDS = 30
TRAINING_TEXTS = 1500
_ADDRESS = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Mme|Monsieur|Madame)"
#: As RE2 reads it: two capitalised words, or one behind a cue or that is a given name, are enough (see `_GIVEN_RE2`).
_UP = "".join(chr(c) for c in range(0x530) if chr(c).isupper())
_GAP = r"[ \t\u00a0]{1,3}"
_PARTICLE = r"(?:van|von|der|den|de|del|della|la|le|di|da|dos|du|bin|al|el|zu|ter)"
_CAP = rf"[{_UP}](?:\.|[^\W\d_]*(?:['’-][^\W\d_]+)*(?!\w))"
_CAPS = re.compile(rf"(?<!\w){_CAP}(?:{_GAP}(?:{_PARTICLE}{_GAP}){{0,2}}{_CAP})*")
_CAP_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")
_CUE_ONE = r"(?:(?:names?|nombre|nom)(?:\s+(?:is|was|ist|es|est)|['’]s|\s*[:=])|named|call me|hei(?:ß|ss)e|m['’]appelle|me llamo|dear|liebe[r]?|regards|sincerely|cheers|signed|attn|(?:author|contact|sender|recipient|customer|patient|employee)\s*:)"
_CUE_MORE = r"(?:i am|i['’]m|ich bin|je suis|soy|this is|contact|(?:written|posted|signed|authored|prepared|reported|created) by|author|ask for|e-?mail|write to|met|hi|hello|hey|thanks|sender|recipient|customer|patient|employee|wife|husband|son|daughter|brother|sister|mother|father|colleague|friend)"
_NAME_CUE = re.compile(rf"(?i)\b(?:({_CUE_ONE})|{_CUE_MORE})[\s,:;-]*$")
_GIVEN = frozenset(
    """james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony steven paul
    andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry
    justin scott brandon benjamin samuel gregory alexander patrick jack dennis jerry tyler aaron jose adam nathan henry douglas
    zachary peter kyle walter ethan jeremy harold keith christian roger noah gerald carl terry sean austin arthur lawrence jesse
    dylan bryan joe jordan billy bruce albert willie gabriel logan alan juan wayne roy ralph randy eugene vincent russell louis philip
    mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily
    donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela shirley anna brenda pamela
    emma nicole helen samantha katherine christine debra rachel carolyn janet catherine maria heather diane ruth julie olivia joyce
    virginia victoria kelly lauren christina joan evelyn judith megan andrea cheryl hannah jacqueline martha gloria teresa ann sara
    madison frances kathryn janice jean alice julia judy sophia denise amber doris marilyn danielle beverly isabella theresa diana
    natalie brittany charlotte marie kayla alexis lori jane alex mike tom bob jim dave steve chris matt nick ben sam dan kate
    hans klaus jürgen wolfgang dieter günter uwe stefan andreas matthias markus sebastian florian lukas jonas felix heinz karl ludwig
    ursula monika petra sabine renate helga karin brigitte ingrid gisela katrin heike anja silke lena sophie leonie
    pierre michel philippe alain bernard françois laurent nicolas jacques olivier julien antoine guillaume camille nathalie isabelle
    sylvie valérie chloé manon amélie élodie céline aurélie
    antonio manuel francisco javier jesús carlos alejandro miguel rafael pedro pablo sergio fernando luis jorge alberto álvaro diego
    carmen josefa isabel dolores pilar ana lucía marta elena rosario cristina raquel
    giovanni giuseppe marco luca paolo francesco giulia chiara ahmed mohamed mohammed muhammad ali fatima omar hassan ivan olga natasha
    sergei dmitri vladimir priya raj amit rahul sanjay anil wei ming yuki hiroshi kenji akira""".split()
)
_GIVEN_RE2 = "(?i:" + "|".join(sorted(_GIVEN)) + ")"
#: Words of names of other things, and words that begin sentences and titles.
_ORG = frozenset(
    """license licence public general software foundation service services support company corporation corp inc ltd llc gmbh group
    university college school institute department ministry committee council team office center centre bank street road avenue lane
    square park bridge river lake mountain city county state states union new san santa saint st north south east west united
    national international central project library systems technologies version section chapter article act law court house
    center press times news world american british german french spanish european""".split()
)
_COMMON = frozenset(
    """the a an of and or but in on at to for from by with is are was were be it this that these those we you he she they i if when
    where what who why how not no yes all any some each there here then than as so do does did can could will would should may might
    must have has had my your his her our their its me us them please see note first last next new
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october
    november december der die das und oder ein eine ist sind im am von mit für nicht le la les des et ou un une est dans pour sur
    avec el los las y en es que por con para del se yesterday today tomorrow after before later also even only once finally meanwhile however both like
    thank thanks hello hi hey dear liebe lieber regards sincerely cheers contact call ask meet met email mail write said""".split()
)
PREFILTER = rf"[0-9@]|\b{_ADDRESS}\b|(?:^|[^\p{{L}}])\p{{Lu}}(?:\.|[\p{{L}}'’-]*)[ \t\x{{a0}}]+(?:{_PARTICLE}[ \t\x{{a0}}]+){{0,2}}\p{{Lu}}|(?i:{_CUE_ONE})[\s,:;-]*\p{{Lu}}|(?:^|[^\p{{L}}]){_GIVEN_RE2}(?:$|[^\p{{L}}])"
_TOKEN = re.compile(r"(?<!\S)\S*[@0-9]\S*")
_NAME = re.compile(rf"\b{_ADDRESS}\b\.?\s+([^\W\d_][^\W_]+(?:-[^\W_]+)*)(?:\s+([^\W\d_][^\W_]+))?")
_TITLE, _PARTICLES = re.compile(rf"{_ADDRESS}\.?"), re.compile(_PARTICLE)
_TRIM = re.compile(r"^[^\w+(@]+|[^\w)]+$")
_WORD = re.compile(r"[^\W_]+")

_SHAPES: list[tuple[str, re.Pattern]] = [
    (k, re.compile(v))
    for k, v in {
        "mail": r"[^@\s]+@[^@\s.]+(\.[^@\s.]+)+",
        "at": r".*@.*",
        "quad": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)",
        "dotted": r"\d+(?:\.\d+)+",
        "plus": r"\+\d{1,3}",
        "area": r"\(\d{2,4}\)",
        "local": r"\d{3,4}[-.]\d{4}",
        "phone10": r"(?:\+\d{1,3}[-.]?)?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}",
        "phoneplus": r"\+\d[\d().-]{7,18}",
        "ssn": r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}",
        "date": r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}",
        "group4": r"\d{4}(?:-\d{4})*",
        "digits": r"\d+",
        "hex": r"(?=.*\d)[0-9a-f]{24,}|(?=.*\d)[0-9A-F]{24,}",
        "base": r"(?=.*\d)(?=.*[a-zA-Z])[\w+/=-]{20,}",
        "prefixed": r"(?:sk|pk|gh[pousr]|xox[abp]|AKIA|AIza)[-_]?[\w-]{12,}",
        "ibanlike": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}",
        "name": r"[^\W\d_]+(?:['’-][^\W\d_]+)*",
    }.items()
]
_CUES = {
    "cue_secret": {"token", "key", "secret", "password", "passwd", "apikey", "api", "credential", "bearer"},
    "cue_phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell"},
    "cue_number": {"version", "order", "invoice", "no", "page", "chapter", "item", "ref", "section", "by", "nc", "isbn"},
    "cue_card": {"card", "visa", "mastercard", "credit", "amex"},
    "cue_ssn": {"ssn", "social"},
}
#: Of a whole run of numbers, and of a sequence of capitalised words.
_RUN = ("run_card", "run_luhn", "run_iban", "run_phone", "run_ssn")
_NAMING = ("capitals", "sequence", "given", "near_given", "cue_name", "org", "common", "particle")
FEATURES = ("bias", *(k for k, _ in _SHAPES), "luhn", "issuer", "iban", "longdigits", "address", *_CUES, *_RUN, *_NAMING)
_AT = {k: i for i, k in enumerate(FEATURES)}


def _words_before(text: str):
    """A function that gives the two whole words before a position, in lower case."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]

    def before(at: int) -> list[str]:
        i = bisect.bisect_left(starts, at)
        return [text[a : min(b, at)].lower() for a, b in words[max(0, i - 2) : i]]

    return before


def luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s)]
    return (sum(d[0::2]) + sum(x // 5 + 2 * x % 10 for x in d[1::2])) % 10 == 0


def iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_NUMBERS = re.compile(r"(?<![\w.,@/+-])\+?\(?\d+\)?(?:[ \t\u00a0-]{1,3}\+?\(?\d+\)?)+(?![\w@]|[.,]\d)")
_SPACED_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ \t\u00a0-]{1,2}[A-Z0-9]{1,30}){1,9}(?!\w)")
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1), (4, 4, 5), (8, 8)}


def _phone_or_ssn(s: str, n: tuple[int, ...], d: str) -> str:
    if n == (3, 2, 4) and re.fullmatch(r"(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}", d) and "+" not in s and "(" not in s:
        return "run_ssn"
    if "+" in s[1:]:
        return ""
    if s[0] == "+":
        return "run_phone" if 8 <= len(d) <= 15 and n[0] <= 4 else ""
    if n == (3, 3, 4) and d[0] in "23456789" or n == (1, 3, 3, 4) and d[0] == "1":
        return "run_phone"
    if s[0] == "(":
        return "run_phone" if 7 <= len(d) <= 12 and 2 <= n[0] <= 5 else ""
    return "run_phone" if d[0] == "0" and d[1:2] != "0" and 9 <= len(d) <= 12 and min(n) >= 2 else ""


def _runs(text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """`(start, end, features)` of numbers that are written as several tokens."""
    out: list[tuple[int, int, tuple[str, ...]]] = []
    for m in _SPACED_IBAN.finditer(text):
        ends = [m.start() + x.end() for x in re.finditer(r"[A-Z0-9]+", m.group())]
        for b in reversed(ends):
            s = re.sub(r"[^A-Z0-9]", "", text[m.start() : b])
            if 15 <= len(s) <= 34 and iban_ok(s):
                out.append((m.start(), b, ("run_iban",)))
                break
    for m in _NUMBERS.finditer(text):
        if not re.search(r"\s", m.group()) or any(a < m.end() and m.start() < b for a, b, _ in out):
            continue
        at = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"\+?\(?\d+\)?", m.group())]
        digits = [re.sub(r"\D", "", text[a:b]) for a, b in at]
        size = [len(x) for x in digits]

        def kind(i: int, j: int, card: bool) -> str:
            a, b, n, d = at[i][0], at[j - 1][1], tuple(size[i:j]), "".join(digits[i:j])
            if not card:
                return _phone_or_ssn(text[a:b], n, d) if j - i > 1 else ""
            plain = "+" not in text[a:b] and "(" not in text[a:b]
            return ("run_card" if n in _CARD_GROUPS else "run_luhn") if plain and j - i > 1 and 13 <= len(d) <= 19 and d[0] in "23456" and luhn(d) else ""

        def tiles(i: int, j: int) -> list[tuple[int, int, str]]:
            """Phones and the like that together are all of the groups `i` to `j`."""
            best: list = [None] * (j - i) + [[]]
            for a in range(j - 1, i - 1, -1):
                for b in range(j, max(a + 1, 0), -1):
                    if b - a <= 8 and best[b - i] is not None and (k := kind(a, b, False)):
                        best[a - i] = [(a, b, k), *best[b - i]]
                        break
            return best[0] or []

        found: list[tuple[int, int, str]] = []
        i = free = 0
        while i < len(at):
            card = next(((j, k) for want in ("run_card", "run_luhn") for j in range(min(len(at), i + 19), i + 1, -1) if (k := kind(i, j, True)) == want), None)
            if card and (card[1] == "run_card" or i == 0 and card[0] == len(at)):
                found += [*tiles(free, i), (i, card[0], card[1])]
                i = free = card[0]
            else:
                i += 1
        found += tiles(free, len(at))
        out += [(at[a][0], at[b - 1][1], (k,)) for a, b, k in found]
    return out


def _names(text: str) -> list[tuple[list[tuple[int, int]], list[tuple[str, ...]], bool]]:
    """Of each sequence of capitalised words: the words, their features, and whether anything speaks for a person."""
    out = []
    for m in _CAPS.finditer(text):
        words = [(m.start() + x.start(), m.start() + x.end()) for x in _CAP_WORD.finditer(m.group())]
        words = [(a, b if b - a == 2 else b - (text[b - 1] == ".")) for a, b in words]
        pieces: list[list[tuple[int, int]]] = [[]]
        for a, b in words:
            if _TITLE.fullmatch(text[a:b]):
                pieces.append([])
            else:
                pieces[-1].append((a, b))
        out += [x for p in pieces if p and (x := _named(text, p))]
    return out


def _named(text: str, words: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[str, ...]], bool] | None:
    # words that only begin the sentence aren't part of a name
    while len(words) > 1 and text[words[0][0] : words[0][1]].lower() in _COMMON:
        words = words[1:]
    low = [text[a:b].lower() for a, b in words]
    before = _NAME_CUE.search(text[max(0, words[0][0] - 40) : words[0][0]])
    cue = bool(before and (before.group(1) or len(words) > 1))
    given = [not _GIVEN.isdisjoint(w.split("-")) for w in low]
    if len(words) == 1 and (not cue and not given[0] or low[0] in _COMMON):
        return None
    whole = ["capitals"] + ["sequence"] * (len(words) > 1) + ["near_given"] * any(given) + ["cue_name"] * cue + ["org"] * (not _ORG.isdisjoint(low))
    each = [(*whole, *["given"] * g, *["common"] * (w in _COMMON), *["particle"] * bool(_PARTICLES.fullmatch(w))) for w, g in zip(low, given)]
    return words, each, cue or any(given)


def _features(core: str, before: list[str], address: bool, more: tuple[str, ...] = ()) -> list[int]:
    on = [0, *(_AT[k] for k in more)]
    for k, p in _SHAPES:
        if p.fullmatch(core):
            on.append(_AT[k])
    digits = re.sub(r"[ -]", "", core)
    if digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19:
        on.append(_AT["longdigits"])
        if luhn(digits):
            on.append(_AT["luhn"])
        if digits[0] in "23456":
            on.append(_AT["issuer"])
    if _AT["ibanlike"] in on and iban_ok(core):
        on.append(_AT["iban"])
    if address:
        on.append(_AT["address"])
    for k, words in _CUES.items():
        if not words.isdisjoint(before):
            on.append(_AT[k])
    return on


class Graph:
    """Nodes of a batch with their features, and its chain and skip edges."""

    def __init__(self):
        self.doc, self.start, self.end, self.on = [], [], [], []
        self.chain, self.skip = [], []
        self.run = []  # where the number of several tokens begins that the node is part of, or -1

    def add(self, number: int, text: str) -> None:
        spans: dict[int, tuple[int, bool]] = {}
        for m in _TOKEN.finditer(text):
            core = _TRIM.sub("", m.group())
            if core:
                a = m.start() + m.group().index(core)
                # long runs of quotes and signs may hold several parts, as in key="value"
                parts = list(re.finditer(r"[^\"'<>=;,|]+", core)) if re.search(r"[\"'<>=;,|]", core) else None
                for p in parts or [None]:
                    c = core if p is None else _TRIM.sub("", p.group())
                    if c and re.search(r"[@0-9]", c):
                        b = a if p is None else a + p.start() + p.group().index(c)
                        spans[b] = (b + len(c), False)
        more: dict[int, tuple[str, ...]] = {}
        of: dict[int, int] = {}
        for x, y, on in _runs(text):
            inside = [a for a in spans if x <= a < y]
            for a in inside:
                del spans[a]
            # a phone number's groups are nodes that say something by themselves, other numbers are one node
            for m in re.finditer(r"\S+" if on == ("run_phone",) else r"(?s).+", text[x:y]):
                spans[x + m.start()] = (x + m.end(), False)
                more[x + m.start()], of[x + m.start()] = on, x
        names: set[str] = set()
        for words, each, person in _names(text):
            for (a, b), on in zip(words, each):
                if a not in spans:
                    spans[a] = (b, False)
                    more[a] = on
                    if person and "common" not in on and "particle" not in on and b - a > 2:
                        names.add(text[a:b])
        for m in _NAME.finditer(text):
            for g in (1, 2):
                if m.group(g) and m.group(g)[0].isupper():
                    spans[m.start(g)] = (m.end(g), True)
                    names.add(m.group(g))
                else:
                    break
        if names:
            for m in _CAP_WORD.finditer(text):
                if m.group().rstrip(".") in names and m.start() not in spans:
                    spans[m.start()] = (m.end() - m.group().endswith("."), False)
        mentions: dict[str, int] = {}
        words_before = _words_before(text) if spans else None
        last = -1
        for a in sorted(spans):
            b, address = spans[a]
            core, i = text[a:b], len(self.doc)
            before = words_before(of.get(a, a))
            self.doc.append(number)
            self.start.append(a)
            self.end.append(b)
            self.on.append(_features(core, before, address, more.get(a, ())))
            self.run.append(of.get(a, -1))
            if last >= 0 and i and self.doc[i - 1] == number and not re.search(r"\w", text[last:a]) and "\n" not in text[last:a]:
                self.chain.append((i - 1, i))
            last = b
            digits = re.sub(r"\D", "", core)
            for key in {core.lower(), digits if len(digits) >= 7 else core.lower()}:  # equal, or similar but for punctuation
                j = mentions.get(key)
                if j is not None and (j, i) not in self.skip[-4:]:
                    self.skip.append((j, i))
                mentions[key] = i

    def design(self) -> np.ndarray:
        x = np.zeros((len(self.doc), len(FEATURES)))
        for i, on in enumerate(self.on):
            x[i, on] = 1
        return x

    def edges(self, which: str) -> np.ndarray:
        return np.array(getattr(self, which), dtype=np.int64).reshape(-1, 2)


def _soft(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class SkipChainCRF:
    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def train(cls, g: Graph, labels: np.ndarray, steps: int = 300, l2: float = 2e-3):
        """Maximum pseudo-likelihood: each label given its neighbours' true labels, by Adam."""
        k = len(LABELS)
        x, chain, skip = g.design(), g.edges("chain"), g.edges("skip")
        y = np.eye(k)[labels]
        w = [np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros((k, k))]
        first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for step in range(1, steps + 1):
            s = x @ w[0]
            for e, m in ((chain, w[1]), (skip, w[2])):
                np.add.at(s, e[:, 0], y[e[:, 1]] @ m.T)
                np.add.at(s, e[:, 1], y[e[:, 0]] @ m)
            d = (_soft(s) - y) / len(y)
            grads = [x.T @ d]
            for e in (chain, skip):
                grads.append(d[e[:, 0]].T @ y[e[:, 1]] + y[e[:, 0]].T @ d[e[:, 1]])
            grads[2] = (grads[2] + grads[2].T) / 2  # similarity has no direction
            for i, gr in enumerate(grads):
                gr = gr + l2 * w[i] / 10
                first[i] = 0.9 * first[i] + 0.1 * gr
                second[i] = 0.99 * second[i] + 0.01 * gr**2
                w[i] = w[i] - 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
        return cls(*w)

    def marginals(self, g: Graph, rounds: int = ROUNDS, damping: float = 0.3) -> np.ndarray:
        """Node beliefs by loopy belief propagation over all documents of the graph together."""
        s = g.design() @ self.unary
        pairs = [(g.edges("chain"), self.chain), (g.edges("skip"), self.skip)]
        src = np.concatenate([c for e, _ in pairs for c in (e[:, 0], e[:, 1])])
        dst = np.concatenate([c for e, _ in pairs for c in (e[:, 1], e[:, 0])])
        if not len(src):
            return _soft(s)
        pot = np.concatenate([np.broadcast_to(m, (len(e), *m.shape)) for e, w in pairs for m in (w, w.T)])
        n = [len(e) for e, _ in pairs for _ in (0, 1)]
        at = np.cumsum([0, *n])
        back = np.concatenate([np.arange(at[1], at[2]), np.arange(at[0], at[1]), np.arange(at[3], at[4]), np.arange(at[2], at[3])])
        msg = np.zeros((len(src), len(LABELS)))
        for _ in range(rounds):
            total = s.copy()
            np.add.at(total, dst, msg)
            out = (total[src] - msg[back])[:, :, None] + pot
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            new = (1 - damping) * new + damping * msg
            if np.abs(new - msg).max() < 1e-4:
                msg = new
                break
            msg = new
        np.add.at(s, dst, msg)
        return _soft(s)


def generated(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their entities (start, end, label), and numbers of other kinds."""
    r = random.Random(seed)
    given, organisation, begins = sorted(_GIVEN), sorted(_ORG), sorted(_COMMON)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeinorstlu") for _ in range(r.randint(2, 8)))

    def card(valid=True):
        s = r.choice("3455556") + digits(14) if not valid or r.random() < 0.5 else "4" + digits(14)
        return next(s + str(c) for c in range(10) if luhn(s + str(c)) == valid)

    def iban():
        body = digits(18)
        return next(f"DE{c:02d}{body}" for c in range(2, 99) if iban_ok(f"DE{c:02d}{body}"))

    def pieces(kind):
        if kind == "EMAIL":
            return [(r.choice([word(), word() + "." + word(), word() + "." + digits(2), word() + "_" + digits(3)]) + "@" + word() + r.choice(["", digits(1)]) + r.choice([".com", ".example.com", ".org", ".co.uk"]), kind)]
        if kind == "PHONE":
            form = r.random()
            if form < 0.4:
                two = lambda: digits(2)
                return [(r.choice(["call ", "", "", ""]), "O"), (r.choice([*[f"{r.randint(2, 9)}{two()} {digits(3)} {digits(4)}"] * 3, f"+{r.randint(1, 99)} {digits(2)} {digits(4)} {digits(4)}", f"+1 {digits(3)} {digits(3)} {digits(4)}", f"+33 {r.randint(1, 9)} {two()} {two()} {two()} {two()}", f"0{r.randint(1, 9)} {two()} {two()} {two()} {two()}", f"0{r.randint(10, 99)} {digits(4)} {digits(4)}", f"({digits(3)}) {digits(3)} {digits(4)}", f"+49 {digits(3)} {digits(7)}"]), kind)]
            if form < 0.65:
                return [(f"+{r.randint(1, 99)}", kind), (f"({digits(3)})", kind), (f"{digits(3)}-{digits(4)}", kind)]
            if form < 0.78:
                return [(f"{digits(3)}-{digits(3)}-{digits(4)}", kind)]
            if form < 0.9:
                return [(f"({digits(3)})", kind), (f"{digits(3)}-{digits(4)}", kind)]
            return [(f"+{r.randint(1, 99)}{digits(10)}", kind)]
        if kind == "CARD":
            c = card()
            if r.random() < 0.15:
                c = "3" + r.choice("47") + digits(12)
                c = next(c + str(x) for x in range(10) if luhn(c + str(x)))
                return [(f"{c[:4]} {c[4:10]} {c[10:]}", kind)]
            if r.random() < 0.1:
                return [(r.choice(["card ", "visa "]), "O"), (f"{c[:5]} {c[5:10]} {c[10:]}", kind)]
            return [(c, kind)] if r.random() < 0.6 else [(r.choice("-  ").join(c[i : i + 4] for i in range(0, 16, 4)), kind)]
        if kind == "IP":
            return [(".".join(str(r.randint(0, 255)) for _ in range(4)), kind)]
        if kind == "SECRET":
            s = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64])))
            s = r.choice([s, s.upper(), "sk_" + digits(10) + word() + digits(8), "AKIA" + word().upper() + digits(12)])
            return [(r.choice(["token", "key", "secret", "api key", "password"]) + r.choice([" = ", ": ", " "]), "O"), (s, kind)]
        if kind == "SSN":
            return [(r.choice(["ssn ", ""]), "O"), (r.choice("-- ").join((f"{r.randint(100, 665)}", f"{r.randint(10, 99)}", f"{r.randint(1000, 9999)}")), kind)]
        if kind == "IBAN":
            s = iban()
            return [(s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4)), kind)]
        if kind == "PERSON" and r.random() < 0.5:
            name = r.choice(given).capitalize() if r.random() < 0.6 else ""
            cue = r.choice(["my name is ", "contact ", "written by ", "Dear ", "thanks, ", "I am ", "author: ", "friend "]) if not name or r.random() < 0.5 else ""
            last = r.choice(["", "", "", f"{word()[0].upper()}. ", r.choice(["van ", "de ", "von "])]) + word().capitalize() + r.choice(["", "", "", "-" + word().capitalize()])
            return [*[(cue, "O")] * bool(cue), (f"{name or word().capitalize()} {last}" if r.random() < 0.85 or not name else name, kind)]
        if kind == "PERSON":
            return [(r.choice(["Mr. ", "Dr ", "Mrs. ", "Herr ", "Frau ", "Prof. "]), "O"), (word().capitalize(), kind)]
        if r.random() < 0.3:
            thing = f"{r.choice(organisation).capitalize()} {r.choice(organisation).capitalize()}"
            cap = lambda: word().capitalize()
            return [(r.choice([f"{cap()} {cap()}", f"{cap()} {cap()} {cap()}", f"{r.choice(begins).capitalize()} {cap()}", thing, f"{thing} {cap()}", f"{cap()} {thing}", f"contact {thing}", f"written by {cap()} {thing}", f"thanks, {thing}", f"friend {cap()} {r.choice(organisation).capitalize()}", f"{r.choice(begins).capitalize()} {r.choice(begins).capitalize()}"]), "O")]
        if r.random() < 0.2:
            c, f = card(False), digits(8)
            return [(r.choice([" ".join(c[i : i + 4] for i in range(0, 16, 4)), f"{c[:5]} {c[5:10]} {c[10:]}", f"{card()[:5]} {digits(5)} {digits(6)}", f"{digits(2)} {digits(3)} {digits(2)}", f"{r.choice(['order', 'invoice'])} {r.randint(2, 9)}{f[:2]} {f[2:5]} {digits(4)}", f"20{digits(2)} 0{r.randint(1, 9)} {r.randint(10, 28)}", f"{digits(4)} {digits(4)}", f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)}", f"{r.randint(1, 9)} {digits(3)} {digits(3)}"]), "O")]
        return [(r.choice([card(False), card(False), digits(r.choice([1, 2, 3, 4, 5, 8, 10, 12])), f"{r.randint(0, 9)}.{r.randint(0, 9)}", f"v{r.randint(0, 9)}.{r.randint(0, 9)}.{digits(2)}", f"20{digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"version {r.randint(1, 9)}", f"{r.randint(300, 999)}.{r.randint(0, 99)}.{r.randint(0, 9)}.{r.randint(0, 9)}", word() + digits(2), f"{digits(2)}%", f"invoice {digits(7)}", f"order {digits(9)}"]), "O")]

    out = []
    for _ in range(n):
        text, found, said = "", [], []
        for _ in range(r.randint(1, 6)):
            text += " ".join(word() for _ in range(r.randint(1, 5))) + " "
            kind = r.choice([*LABELS[1:], "O", "O", "O", "O"])
            again = said and r.random() < 0.35
            parts = r.choice(said) if again else pieces(kind)
            if not again:
                said.append(parts[1:] if parts[0][0].endswith(" ") and len(parts) > 1 and kind == "PERSON" else parts)
            for p, k in parts:
                quote = '"' if k == "SECRET" and r.random() < 0.5 else ""
                text += quote
                if k != "O":
                    found.append((len(text), len(text) + len(p), k))
                text += p + quote + r.choice(["", "", "", ".", ",", "!!"] if p is parts[-1][0] else [""]) + (" " if not p.endswith(" ") else "")
            text += r.choice(["", "", "\n"])
        out.append((text, found))
    return out


@functools.cache
def model() -> SkipChainCRF:
    """The field trained on generated texts; the same on every machine."""
    g, labels = Graph(), []
    for i, (text, found) in enumerate(generated(TRAINING_TEXTS)):
        at = len(g.doc)
        g.add(i, text)
        for a, b in zip(g.start[at:], g.end[at:]):
            labels.append(next((LABELS.index(k) for x, y, k in found if x <= a and b <= y), 0))
    return SkipChainCRF.train(g, np.array(labels))


def find(texts: list[str], crf: SkipChainCRF | None = None) -> list[list[tuple[int, int, str]]]:
    """Entities (start, end, label) of each text; neighbouring parts of one label are one entity."""
    g = Graph()
    for i, t in enumerate(texts):
        g.add(i, t)
    out: list[list] = [[] for _ in texts]
    if not g.doc:
        return out
    label = (crf or model()).marginals(g).argmax(axis=1)
    joined = {b for a, b in g.chain if label[a] == label[b] and (LABELS[label[a]] in ("PHONE", "PERSON", "CARD") or g.run[a] == g.run[b] >= 0)}
    for i, (d, a, b, k) in enumerate(zip(g.doc, g.start, g.end, label.tolist())):
        if k:
            if i in joined and out[d]:
                out[d][-1] = (out[d][-1][0], b, LABELS[k])
            else:
                out[d].append((a, b, LABELS[k]))
    return out


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, k in found:
        parts += [text[at:a], f"<{k}>"]
        at = b
    return "".join(parts) + text[at:]


def _masked(docs: DataFrame) -> DataFrame:
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    crf = docs.sparkSession.sparkContext.broadcast(model())
    own = _columns.numbered(docs)
    schema = T.StructType([*own.schema.fields, T.StructField("found", T.StringType())])

    def run(it):
        for batch in it:
            texts = batch.column(text_at)
            maybe = pc.fill_null(pc.match_substring_regex(texts, PREFILTER), False).to_pylist()
            at = [i for i, x in enumerate(maybe) if x]
            some = [texts[i].as_py() for i in at]
            said, new = [""] * batch.num_rows, {}
            for s in range(0, len(some), 256):
                for i, t, found in zip(at[s : s + 256], some[s : s + 256], find(some[s : s + 256], crf.value)):
                    if found:
                        new[i] = mask(t, found)
                        kinds = [k for *_, k in found]
                        said[i] = ",".join(f"{k}:{kinds.count(k)}" for k in LABELS if k in kinds)
            columns = list(batch.columns)
            if new:
                columns[text_at] = pa.array([new.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
                if chars_at is not None:
                    columns[chars_at] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(columns[chars_at].to_pylist())], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said)], names=[*batch.schema.names, "found"])
        _vec.trim()

    return own.mapInArrow(run, schema)


def mask_documents(docs: DataFrame) -> DataFrame:
    """`docs` with personal data masked in `text`, and `n_chars`, where there is such a column, updated.

    Null and empty texts stay. Every row is handled by itself, so repeated rows and null ids need no care,
    and the same text always gives the same result. Other columns, of whatever name, stay as they are. Empty input
    gives an empty result.
    """
    return _masked(docs).drop("found").toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """`(doc_id, text, found)`: masked text, and what was found as `KIND:count` joined by commas."""
    return _masked(docs.select("doc_id", "text")).toDF("doc_id", "text", "found")
