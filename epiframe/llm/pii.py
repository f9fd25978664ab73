"""Personal data: patterns, and a linear-chain conditional random field over word shapes (operator 9).

The field labels words as email, phone, card, ip, name or other from the shapes of a word and its two neighbours (with
cue words such as "phone" or "Herr" as shapes of their own, and shapes of numbers told apart by the last cue of the four
words before them), and from the label before it. It is trained on the small
labelled table below (``TRAINING``) by gradient ascent on the likelihood, on the driver, in some seconds and alike each
time; tasks get its weights. The best labels of a whole text are decoded, exactly, block by block in numpy. Runs of one
label are spans ``crf_<label>``; those on a base span are left out.

Defined cases: a null or empty text has no spans; a text of any length is one chain; an empty table gives no rows; repeated rows are judged alike; extra
columns stay, and columns with the names of results are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", "email", "ip", "card", "phone", "name")
ORDER = {k: i for i, k in enumerate([*KINDS, *(f"crf_{k}" for k in LABELS[1:])])}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can start only where a run of digits does, which the look-behind says outright
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """By the @ signs, so that long runs of local characters are read once."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            past = m.end()
        at = text.find("@", max(at + 1, past))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base finds by start, then kind."""
    found = list(_emails(text))
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


# Word shapes. Bytes have classes; counts of classes in a word, less its final punctuation, give the shape.
CLASS = np.full(256, 7, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 @, 4 dot, 5 dash or bracket or plus, 6 other punctuation, 7 other, 8 inside a character
CLASS[list(range(97, 123)) + list(range(192, 256))] = 0
CLASS[128:192] = 8
CLASS[list(range(65, 91))] = 1
CLASS[list(range(48, 58))] = 2
CLASS[ord("@")], CLASS[ord(".")] = 3, 4
CLASS[list(b"-()+")] = 5
CLASS[list(b",;:!?'\"")] = 6
SHAPES = "plain capital upper digits2 digits3 digits4 digits11 digits12 digits16 digits19 dotted phonelike phonelong address at_sign mixed symbols capitalstop initial bracketed".split()
#: Words of the four languages that say what stands beside them.
CUES = {
    "name": "name mr mrs ms miss dr prof sir contact kontakt contacto dear hello hi regards author nom monsieur madame mme herr frau sehr nombre señor señora don doña",
    "tel": "call phone tel fax mobile telephone cell dial ring text whatsapp telefon handy tél téléphone mobil teléfono móvil anruf rufnummer appelez llame",
    "at": "at [at] (at) {at} arroba", "dot": "dot [dot] (dot) {dot} punkt punto",
    "pay": "card visa mastercard amex credit karte kreditkarte carte tarjeta iban account", "mail": "email mail e-mail write courriel correo", "host": "ip host server address router",
    "ref": "order invoice id ref isbn number no item tracking serial ssn social code zip version rechnung bestellung commande facture pedido factura",
    "unit": "page pages chapter section year years room floor volume verse lines km miles seite seiten kapitel página páginas chapitre", "ask": "reach ask tell met thank invite", "close": "sincerely yours cheers thanks cordialement atentamente saludos grüße gruß", "link": "is was ist est es war",
    "article": "the a an this that der die das den dem einem einer le la les un une el los las una my his her our their",
}
#: Shapes of numbers, and the cues that tell what a number after them is.
NUMBERS = "digits2 digits3 digits4 digits11 digits12 digits16 digits19 phonelike phonelong".split()
SAID = "tel pay ref unit".split()
FEATURES = [*SHAPES, *CUES, "named", "dialed", "spelled", "parted", "numbered", *(f"{x} {c}" for c in SAID for x in NUMBERS), "edge"]
#: Words between a cue and a number at most.
REACH = 4
AT_INSIDE = re.compile(rb"[\[({](?:at|At|AT)[\])}]")
EDGE = len(FEATURES) - 1
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longest cue in bytes, as two numbers of 8 bytes.
_LONGEST = 16


def _cue_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cues as pairs of 8-byte numbers in order of the first, and their features."""
    words = {w.encode(): FEATURES.index(k) for k, v in CUES.items() for w in v.split()}
    keys = np.frombuffer(b"".join(w.ljust(_LONGEST, b"\0") for w in words), "<u8").reshape(-1, 2)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    return keys[order, 0] ^ keys[order, 1] * np.uint64(0x9E3779B97F4A7C15), keys[order], np.array(list(words.values()))[order]


def _cues(raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Feature of each word that is a cue in either case of ASCII letters, else -1."""
    mixed, keys, feature = _cue_table()
    order = np.argsort(mixed)
    mixed, keys, feature = mixed[order], keys[order], feature[order]
    out = np.full(len(starts), -1)
    for k in range(0, len(starts), 1 << 16):
        on = np.flatnonzero((length[k : k + (1 << 16)] <= _LONGEST) & (length[k : k + (1 << 16)] > 0)) + k
        at = starts[on, None] + np.arange(_LONGEST)
        letters = LOWER[raw[np.minimum(at, len(raw) - 1)]]
        letters[np.arange(_LONGEST) >= length[on, None]] = 0
        pair = np.ascontiguousarray(letters).view("<u8")
        h = pair[:, 0] ^ pair[:, 1] * np.uint64(0x9E3779B97F4A7C15)
        j = np.minimum(np.searchsorted(mixed, h), len(mixed) - 1)
        same = (keys[j] == pair).all(1)
        out[on[same]] = feature[j[same]]
    return out


@functools.cache
def _capitals() -> np.ndarray:
    """Whether each code point is a capital."""
    return np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x110000)])


def _classes(raw: np.ndarray) -> np.ndarray:
    """Class of each byte; a character of several bytes has it at the first, 0 or, of capitals, 1."""
    kind = CLASS[raw]
    for low, high, mask, size in ((192, 224, 0x1F, 2), (224, 240, 0x0F, 3), (240, 256, 0x07, 4)):
        at = np.flatnonzero((raw >= low) & (raw < high))
        if len(at):
            point = (raw[at] & mask).astype(np.int64)
            for k in range(1, size):
                point = point << 6 | raw[at + k] & 0x3F
            kind[at[_capitals()[point]]] = 1
    return kind


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words given as byte spans, and the words' ends without final punctuation."""
    kind = _classes(raw)
    final = np.isin(raw, np.frombuffer(b".,;:!?", np.uint8))
    # the last byte that is not final punctuation, or the start
    solid = np.where(final, -1, np.arange(len(raw)))
    solid = np.maximum.accumulate(solid) if len(raw) else solid
    stop = np.maximum(solid[ends - 1] + 1, starts) if len(ends) else ends
    count = lambda k: (c := np.concatenate([[0], np.cumsum(kind == k)]))[stop] - c[starts]
    low, up, dig, at, dot, dash, punct = (count(k) for k in range(7))
    length = stop - starts
    size = length - count(8)
    f = np.full(len(starts), FEATURES.index("symbols"))
    put = lambda name, where: np.putmask(f, where, FEATURES.index(name))
    put("mixed", (dig > 0) & (low + up > 0))
    put("phonelike", (dig >= 3) & (dash > 0) & (low + up + at == 0))
    put("phonelong", (dig >= 9) & (dash > 0) & (low + up + at == 0))
    put("dotted", (dig >= 4) & (dot >= 3) & (dig + dot == size))
    for name, a, b in (("digits2", 1, 2), ("digits3", 3, 3), ("digits4", 4, 4), ("digits11", 5, 11), ("digits12", 12, 12), ("digits16", 13, 16), ("digits19", 17, 19)):
        put(name, (dig == size) & (dig >= a) & (dig <= b))
    put("upper", (up == size) & (up > 1))
    put("capital", (up == 1) & (low + up + punct == size) & ((kind[starts] == 1) if len(starts) else False))
    put("plain", (low + punct + dash == size) & (low > 0) | (size == 0))
    ended = stop < ends
    put("capitalstop", (f == FEATURES.index("capital")) & ended)
    put("initial", (up == 1) & (size == 1) & ended & (raw[np.minimum(stop, len(raw) - 1)] == ord(".")) if len(starts) else False)
    put("at_sign", at > 0)
    inside = np.array([m.start() for m in AT_INSIDE.finditer(raw.tobytes())], np.int64)
    if len(inside):
        word = np.searchsorted(starts, inside, "right") - 1
        word = word[(word >= 0) & (inside > starts[word]) & (inside + 4 < stop[word])]
        f[word] = FEATURES.index("bracketed")
    put("address", (at == 1) & (dot > 0) & (low + up + dig > 2))
    cue = np.where(f == FEATURES.index("initial"), -1, _cues(raw, starts, length))
    return np.where(cue >= 0, cue, f), stop


def in_context(f: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Features of words by those beside them in their text: "is" after a cue of names or phones says that one follows, "at"
    two words before "dot" is one in a spelled address, and "dot" two words before such an "at" too, "number" after a card
    is its number's cue, and a number has the last cue of the ``REACH`` words before it; an article between "at" and "dot"
    speaks of a place, and is a plain word, as any other "is" is."""
    number, out = FEATURES.index, f.copy()
    link = f == number("link")
    named = link & (np.roll(f, 1) == number("name")) & (np.diff(doc, prepend=-1) == 0)
    out[link] = np.where(named[link], number("named"), number("plain"))
    article = f == number("article")
    out[article] = number("plain")
    far = (np.roll(f, -2) == number("dot")) & (np.roll(doc, -2) == doc) & ~np.roll(article, -1)
    far[-2:] = False
    out[(f == number("at")) & far] = number("spelled")
    same = np.diff(doc, prepend=-1) == 0
    paid = (f == number("ref")) & (np.roll(f, 1) == number("pay")) & same
    out[paid] = number("numbered")
    out[link & (np.roll(f, 1) == number("tel")) & same] = number("dialed")
    parted = (f == number("dot")) & (np.roll(out, -2) == number("spelled")) & (np.roll(doc, -2) == doc)
    parted[-2:] = False
    out[parted] = number("parted")
    said = np.full(len(f), -1)
    for k in range(min(REACH, len(f) - 1), 0, -1):  # the nearest cue counts
        for c, name in enumerate(SAID):
            cue = np.zeros(len(f), bool)
            cue[k:] = (out[:-k] == number(name)) & (doc[:-k] == doc[k:])
            if name == "pay":
                cue[k:] |= (out[:-k] == number("numbered")) & (doc[:-k] == doc[k:])
            said[cue] = c
    first = number(f"{NUMBERS[0]} {SAID[0]}")
    for j, name in enumerate(NUMBERS):
        on = (f == number(name)) & (said >= 0)
        out[on] = first + said[on] * len(NUMBERS) + j
    return out


#: The labelled table: words, each with the first letter of its label after a slash where it is not other.
TRAINING = """
Write to bob.42@mail.example.com/e today
her address is a.b@x.org/e and the other one
Email jane/e at/e example/e dot/e com/e for it
mail jdoe/e at/e example/e dot/e org/e now
email Peter/e [at]/e corp/e [dot]/e net/e soon
or by mail: mary.k/e (at)/e site/e (dot)/e org/e please
reach me under tom/e at/e company/e dot/e net/e any day
her mail is mia/e at/e lake/e dot/e net/e again
the mail was late
write anna/e [at]/e web/e [dot]/e de/e to her
correo luis/e arroba/e dominio/e punto/e es/e hoy
schreib an uwe/e at/e firma/e punkt/e de/e bitte
send it to k99/e at/e mail/e dot/e com/e tonight
you can mail max/e at/e island/e dot/e org/e and then we will see what can be done about all of it in the time that is left to us
write to eve/e (at)/e valley/e (dot)/e com/e if there is more to say about the way that they went on from there to the end of the long road
some of the people who came that day went home again before the rain began and the others stayed on until the lamps were lit in the street
the road goes on and on down from the door where it began and now far ahead the road has gone and we must follow if we can
nobody knew what to make of it but they went along with the plan and so it came that the old bridge was built anew
we meet at noon
They stood at The gate of it
we looked at all of it and left
he is at home and she is at work
a dot on it
the dot and the line
look at Monday and a dot there
at the dot we stop
punkt und komma sind da
un punto es un punto
mail the letter at once
write it down at night
call +1/p (555)/p 123-4567/p after five
phone (212)/p 555-0182/p or come
tel 212-555-0182/p is mine
Call 555/p 123/p 4567/p tonight
mobile 0171/p 5551234/p works
fax 030/p 1234567/p please
phone 5551234567/p is hers
call 5550134/p before noon
cell: 555-0199/p
the number +44/p 20/p 7946/p 0958/p is his
reach us under (030)/p 555-7788/p today
Telefon 089/p 555123/p am Abend
tél 01/p 55/p 50/p 12/p 34/p demain
teléfono 915/p 550/p 123/p siempre
dial 555/p 0147/p and wait
or on 555/p 204/p 7788/p then
she has 212-555-0144/p as well
or 0171-5550-199/p then
between 100-200 of them
in 2019 there were 300 of them
about 12 of 45 and 1200 more
from 1999 to 2005 it grew
the sum is 45000 in all
page 123 of 4567 there
on 12 March 1999 it was
chapter 4 has 1234 words
we paid 250 and 75 for it
there were 12000 people
between 10-12 and 14-16 of them
it took 3 days and 20 hours
Card 4111/c 1111/c 1111/c 1111/c expires
visa 5500000000000004/c was used
card 3782/c 822463/c 10005/c is old
the card 4111-1111-1111-1111/c again
pay by visa 4000123412341234/c then
and 4539578763621486 of it
was 4716059284112345 here
the 5105105105105100 came
Karte 4012888888881881/c gilt
carte 4222222222222/c perdue
credit card 6011000990139424/c holder
on 4929123456789012 Then
They 4485275742308327 and
it. 4556737586899855
4024007103939509 was
card number 4024007103939509/c was seen
his credit card number 4485275742308327/c leaked
account 4532015112830366/c closed
his card is here
the card was old
order 4000123412341234 came
invoice 5500123412341234 is open
tracking 4111222233334444 shows it
serial 123456789012 and more
id 987654321098765 there
ISBN 9781234567897 is out
item 400012341234 sold
commande 4000123412341234 est là
server 10.0.0.1/i answers
ip 192.168.1.10/i was seen
host 172.16.254.1/i is down
from 8.8.8.8/i it came
router 10.1.2.3/i again
version 1.2.3 is new
name John/n Smith/n is here
My name is Mary/n Jones/n and more
the name is Tom/n and he left
Her name was Anna/n Lee/n before
Dr Alice/n Brown/n called
Mr Miller/n left
Mrs Green/n and Mr White/n came
Prof Karl/n Weber/n spoke
Dear Susan/n thanks for it
Hello Peter/n how are you
Regards Jane/n Doe/n
author Mark/n Twain/n wrote
contact Mrs Green/n today
Contact Paul/n White/n about it
Herr Hans/n Maier/n kommt
Frau Petra/n Koch/n ist da
Monsieur Jean/n Dupont/n arrive
Madame Claire/n Petit/n est ici
señor Luis/n García/n llega
doña Ana/n Ruiz/n vive
mein Name ist Eva/n Braun/n und
The house was old. It fell. Then They came
In The end Of it. Great Things Are near
A Big Day for the Town
Das Haus und der Baum sind Alt
Then Then Then Then Then Then Then Then it fell
So So So So So So So So So So So So
it was at at that time
At at once he said at
at at at at at at once
it came at 5 and at 10
The end at 7 was near
It was. It is. It was. It is.
here. There. Here. There. It fell
NASA and IBM met there
THE END OF IT
name of the rose
the name of The place
a name for it
the contact was lost
hello there
dear me
no number
no one came
he is There
sehr gut und sehr alt
don de la casa
Call me later
Phone them
call it a day
Sincerely, Maria/n Lopez/n
Yours, Tom/n Hill/n
Cheers, Anna/n
Thanks, Peter/n Novak/n
Yours sincerely, Helen/n Marsh/n
Thanks for the help
cheers went up
Cordialement, Luc/n Martin/n
Atentamente, José/n Díaz/n
Saludos, Elena/n
Grüße, Karin/n Wolf/n
Mit bestem Gruß Stefan/n Huber/n
reach Olga/n Ivanova/n before noon
Ask Daniel/n Kim/n about the keys
tell Rosa/n that we left
She met George/n Allen/n at the station
thank Nils/n Berg/n for it
reach the top by noon
ask them and tell us
Kontakt: Uwe/n Brandt/n, Hamburg
Contact: Sara/n Klein/n, London
Contacto: Pedro/n Gil/n, Madrid
Dear Julia/n, Then we left
Mr Carter/n, The owner
Mrs Bell/n. The end
Mr Fox/n, Berlin and Rome
Dr Lee/n, Boston is far
J./n K./n Rowan/n wrote it
by T./n S./n Moore/n in verse
A./n Novak/n signed
M./n Dubois/n est venu
It was plan B. Then it ended
see part C. The rest is here
vitamin D. And so on
Vienna, Rome and Paris, London. Berlin
First, Second, Third
write kim[at]shop[dot]org/e to order
mail ann.b(at)web(dot)net/e today
her address lou[at]mail.example.com/e works
x99{at}host{dot}de/e schreiben
jack/e dot/e hill/e at/e sample/e dot/e com/e is new
mail rita/e dot/e kay/e at/e office/e dot/e net/e soon
write to leo/e dot/e may/e at/e school/e dot/e edu/e please
the dot com years at the time
My phone is 555/p 0188/p now
his phone is 212/p 555/p 0143/p
my mobile is 07911/p 123456/p
the phone was old and the fax was not
ring me on 07700/p 900456/p please
ring her at 020/p 7946/p 0123/p tonight
text me on 07700/p 900789/p later
call us any time at 1800/p 555/p 199/p
my fax is 555-0166/p there
phone me under 0151/p 23456789/p ab acht
appelez le 06/p 12/p 34/p 56/p 78/p vite
llame al 600/p 123/p 456/p hoy
they ring the bell 12 times
the text has 1200 words
SSN 987-65-4320 on the form
ssn 078-05-1120 was shown
social security code 219-09-9999 here
zip code 12345-6789 here
invoice 4539578763621486 is late
Invoice 4716059284112345 paid
order number 5105105105105100 was sent
order no 4012888888881881 again
Rechnung 4222222222222 offen
facture 4539578763621486 jointe
factura 4485275742308327 pagada
version 12 of code 4567
Chapter 12 pages 100 200 300
pages 12 to 340 and 45 more
chapter 3 section 12 lines 100 200
the year 1999 and the years 2001 2002 2003
room 101 on floor 12
Seite 100 bis 200
página 120 y 130
300 km and 1200 miles
from 100 200 300 to 400
1 2 3 4 5 6 7 8 9 10
10 20 30 and 100 200
between 1000 2000 and 3000
my card is 4111/c 1111/c 1111/c 1234/c there
his visa is 4539578763621486/c now
account number 4532015112830366/c was shut
pay with card 5105/c 1051/c 0510/c 5100/c today
x2 and b52 flew
item A-12 or #5 | here
See http://a.b/c?d=1 and more
*** ### |
""".strip()


def _training_rows() -> list[tuple[np.ndarray, np.ndarray]]:
    rows = []
    letter = {k[0]: i for i, k in enumerate(LABELS) if i}
    for line in TRAINING.split("\n"):
        words, labels = [], []
        for w in line.split():
            word, _, mark = w.rpartition("/")
            tagged = bool(word) and mark in letter
            words.append(word if tagged else w)
            labels.append(letter[mark] if tagged else 0)
        raw = np.frombuffer((" ".join(words)).encode(), np.uint8)
        space = np.concatenate([[True], SPACES[raw], [True]])
        edge = np.diff(space.astype(np.int8))
        f, _ = shapes(raw, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1))
        rows.append((in_context(f, np.zeros(len(f), np.int64)), np.array(labels)))
    return rows


def _emissions(f: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores (words, labels) of a sequence of features; weights are (3, features, labels) for before, here, after."""
    before, after = np.concatenate([[EDGE], f[:-1]]), np.concatenate([f[1:], [EDGE]])
    return weights[0][before] + weights[1][f] + weights[2][after]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@functools.cache
def train(rounds: int = 40, rate: float = 0.5, penalty: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights (3, features, labels) and transitions (labels, labels): ascent with per-weight step sizes."""
    rows, n = _training_rows(), len(LABELS)
    w, t = np.zeros((3, len(FEATURES), n)), np.zeros((n, n))
    sw, st = np.full(w.shape, 1e-6), np.full(t.shape, 1e-6)
    for _ in range(rounds):
        gw, gt = -penalty * w, -penalty * t
        for f, y in rows:
            e = _emissions(f, w)
            size = len(f)
            a, b = np.empty((size, n)), np.zeros((size, n))
            a[0] = e[0]
            for k in range(1, size):
                a[k] = e[k] + _logsum(a[k - 1][:, None] + t, 0)
            for k in range(size - 2, -1, -1):
                b[k] = _logsum(t + (e[k + 1] + b[k + 1])[None, :], 1)
            z = _logsum(a[-1], 0)
            d = -np.exp(a + b - z)
            d[np.arange(size), y] += 1
            for j, g in enumerate((np.concatenate([[EDGE], f[:-1]]), f, np.concatenate([f[1:], [EDGE]]))):
                np.add.at(gw[j], g, d)
            for k in range(1, size):
                gt -= np.exp(a[k - 1][:, None] + t + (e[k] + b[k])[None, :] - z)
                gt[y[k - 1], y[k]] += 1
        sw, st = sw + gw**2, st + gt**2
        w, t = w + rate * gw / np.sqrt(sw), t + rate * gt / np.sqrt(st)
    return w, t


#: Words to a block that is decoded beside the others, and to a part of the sequence that is held at once.
BLOCK, PART = 128, 1 << 18


def viterbi(f: np.ndarray, doc: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Labels of all words, decoded over each text.

    All texts are one sequence, without transitions from one to the next. It falls into blocks: their best scores from
    each label before them to each label at their end come first, for all blocks at once; a walk over the blocks picks
    the labels at their ends; then each block is decoded between the labels that were picked.
    """
    size, n = len(f), len(LABELS)
    labels = np.zeros(size, np.int64)
    if not size:
        return labels
    opens, closes = np.diff(doc, prepend=-1) != 0, np.diff(doc, append=-1) != 0
    before, after = np.where(opens, EDGE, np.roll(f, 1)), np.where(closes, EDGE, np.roll(f, -1))

    def part(at: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores (step, label, block) and whether there is a transition (step, block), padded by words without either."""
        to = slice(at, min(at + PART, size))
        blocks = -(-(to.stop - at) // BLOCK)
        e, linked = np.zeros((blocks * BLOCK, n)), np.zeros(blocks * BLOCK)
        e[: to.stop - at] = weights[0][before[to]] + weights[1][f[to]] + weights[2][after[to]]
        linked[: to.stop - at] = ~opens[to]
        return np.ascontiguousarray(e.reshape(blocks, BLOCK, n).transpose(1, 2, 0)), np.ascontiguousarray(linked.reshape(blocks, BLOCK).T)

    score, ways = np.zeros(n), []
    for at in range(0, size, PART):
        e, linked = part(at)
        best = moves[:, :, None] * linked[0] + e[0]  # (label before the block, label, block)
        for k in range(1, BLOCK):
            t = moves[:, :, None] * linked[k]
            now = best[:, 0, None] + t[0]
            for label in range(1, n):
                np.maximum(now, best[:, label, None] + t[label], out=now)
            best = now + e[k]
        way = np.empty((best.shape[2], n), np.int64)
        for b, x in enumerate(best.transpose(2, 0, 1)):
            paths = score[:, None] + x
            way[b] = paths.argmax(0)
            score = paths.max(0)
            score -= score.max()
        ways.append(way)
    last = int(score.argmax())
    for at in reversed(range(0, size, PART)):
        (e, linked), way = part(at), ways.pop()
        blocks = len(way)
        begin, end = np.empty(blocks, np.int64), np.empty(blocks, np.int64)
        for b in reversed(range(blocks)):
            end[b] = last
            begin[b] = last = int(way[b, last])
        each, back = np.arange(blocks), []
        now = moves[begin].T * linked[0] + e[0]
        for k in range(1, BLOCK):
            t = moves[:, :, None] * linked[k]
            top, who = now[0] + t[0], np.zeros((n, blocks), np.int8)
            for label in range(1, n):
                path = now[label] + t[label]
                who[path > top] = label
                np.maximum(top, path, out=top)
            back.append(who)
            now = top + e[k]
        found = np.empty((BLOCK, blocks), np.int64)
        found[-1] = end
        for k in reversed(range(BLOCK - 1)):
            found[k] = back[k][found[k + 1], each]
        labels[at : at + PART] = found.T.ravel()[: min(PART, size - at)]
    return labels


def crf_spans(texts: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[str, int, int]]]:
    """Spans in code points that the field finds in each text."""
    data = [t.encode() + b"\n" if t else b"\n" for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    edge = np.diff(np.concatenate([[True], SPACES[raw]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    f, stops = shapes(raw, starts, ends)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    doc = np.searchsorted(bounds, starts, "right") - 1
    labels = viterbi(in_context(f, doc), doc, *model)
    on = np.flatnonzero(labels)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not len(on):
        return out
    new = np.flatnonzero((np.diff(on, prepend=-9) != 1) | (np.diff(labels[on], prepend=-1) != 0) | (np.diff(doc[on], prepend=-1) != 0))
    point = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with each byte
    for a, b in zip(new, [*new[1:], len(on)]):
        i, j = on[a], on[b - 1]
        d = int(doc[i])
        base = int(point[bounds[d] - 1]) if bounds[d] else 0
        out[d].append((f"crf_{LABELS[labels[i]]}", int(point[starts[i]]) - 1 - base, int(point[stops[j] - 1]) - base))
    return out


RESULTS = {"n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal(docs: DataFrame) -> DataFrame:
    """docs with counts of base finds, their digest, and all spans."""
    names = [c for c in docs.columns if c not in RESULTS]
    df = docs.select(*names)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields], *[T.StructField(c, T.LongType() if c[:2] == "n_" else T.StringType()) for c in RESULTS]])
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                texts, rows = part.column("text").to_pylist(), []
                for text, more in zip(texts, crf_spans(texts, model)):
                    base = base_spans(text) if text else []
                    more = [x for x in more if not any(a < x[2] and x[1] < b for _, a, b in base)]
                    kinds = [k for k, _, _ in base]
                    everything = sorted(base + more, key=lambda s: (s[1], ORDER[s[0]], s[2]))
                    rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(everything)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), RESULTS.values()))], names=[*names, *RESULTS])

    return df.mapInArrow(run, schema)
