"""Plain versions of the pipeline's rules."""

import itertools
import re

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_kept(text):
    w = _words(text)
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k : k + 3]), []).append(k)
    twice = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
    return len(w) >= 50 and 100 * len(twice) <= 50 * len(w)


def plain_set(text):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def plain_roots(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def plain_personal_data(text):
    def ok(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind != "phone" or 8 <= len(digits) <= 15

    return [m.group(0) for k, p in PLAIN.items() for m in re.finditer(p, text) if ok(k, m.group(0))]
