"""Plain Python versions that the operators are held against."""

import hashlib
import re

BLANKS = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(s):
    return s.translate(UP)


def luhn(d):
    return sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def line_dedup(texts, least):
    from collections import Counter
    key = lambda x: low(x.strip(BLANKS))
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, v in n.items() if k and v >= least}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in gone]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out
