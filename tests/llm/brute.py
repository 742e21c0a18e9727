"""Plain versions of the contracts, text by text, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def luhn(s: str) -> bool:
    d = [int(c) for c in s][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def pii(text: str | None) -> tuple:
    text, out = text or "", {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    digits = lambda x: "".join(c for c in x if c in "0123456789")
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    spans = [f"{k}:{s}:{e}" for k in ("email", "ip", "card", "phone") for s, e in sorted(out[k])]
    return (*(len(out[k]) for k in ("email", "ip", "card", "phone")), sha(",".join(spans)), spans)


def secrets(text: str | None) -> tuple:
    text, out = text or "", []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, "assign", m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    spans = [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]
    kinds = Counter(x[2] for x in out)
    return kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(spans)), spans


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def simhash(text: str | None) -> str:
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)):016x}"


def components(prints: dict, most: int = 3) -> dict:
    """{key: smallest key reachable} by links of `most` differing bits or fewer."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if (int(prints[a], 16) ^ int(prints[b], 16)).bit_count() <= most:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def repeats(docs: list[tuple[int, str | None]], window: int = 20) -> dict:
    """{doc_id: (n_words, n_removed, kept_sha256)} for distinct ids."""
    seen: set = set()
    out = {}
    for doc_id, text in sorted(docs, key=lambda x: x[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc_id] = len(words), sum(gone), sha(" ".join(kept))
    return out


def role_repair_cost(roles: list) -> int:
    """Least cost over all ways, each tried: an optional system turn, then user and assistant in turn.

    A turn may take its place as any legal role (free for its own, 2 to relabel a known role,
    1 to name an unknown one), stand behind an inserted empty turn (2, known roles only), or
    be merged into the turn before (1 into its own role, else 3).
    """
    after = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    def ways(k: int, last: str | None) -> int:
        if k == len(roles):
            return 0
        own = roles[k] if roles[k] in ("system", "user", "assistant") else None
        costs = []
        for role in after[last]:
            costs.append((0 if role == own else 2 if own else 1) + ways(k + 1, role))
            if own in after[role]:
                costs.append(2 + ways(k + 1, own))
        if last is not None:
            costs.append((1 if own == last else 3) + ways(k + 1, last))
        return min(costs)

    return ways(0, None)


def role_repair(roles: list) -> list[tuple[str, str]]:
    """[(action, new role)] of the cheapest way, all ways listed; ties as documented."""
    states = [None, "system", "user", "assistant"]
    after = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    ways: list = [[]]
    for given in roles:
        own = given if given in states[1:] else None
        longer = []
        for way in ways:
            last = way[-1][3] if way else None
            for role in after[last]:
                longer.append([*way, (last, 0 if role == own else 2 if own else 1, "keep" if role == own else "relabel", role)])
                if own in after[role]:
                    longer.append([*way, (last, 2, f"insert {role}", own)])
            if last is not None:
                longer.append([*way, (last, 1 if own == last else 3, "merge", last)])
        ways = longer
    least = min(sum(m[1] for m in w) for w in ways)
    rank = ["keep", "merge", "insert", "relabel"]
    key = lambda w: (states.index(w[-1][3]), [(states.index(q), cost, rank.index(action.split()[0])) for q, cost, action, _ in reversed(w)])
    return [(m[2], m[3]) for m in min((w for w in ways if sum(m[1] for m in w) == least), key=key)]


def rendered_chat(texts: list, repair: list[tuple[str, str]]) -> str:
    out = []
    for text, (action, role) in zip(texts, repair, strict=True):
        if action == "merge":
            out[-1][1] += "\n" + text
            continue
        if action.startswith("insert"):
            out.append([action.split()[1], ""])
        out.append([role, text])
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in out)


EDGES = ".,;:!?\"'()[]{}<>"


def disclosing_terms(texts: dict, z: float = 1.645, few: int = 3, reach: int = 8, least: float = 0.5, remove: float = 0.6, bits: float = 4.0) -> dict:
    """{key: [start:end:action]} of the words that reveal an entity, each text by itself."""
    from math import log2, sqrt

    term = lambda w: t if len(t := w.strip(EDGES).lower()) >= 3 else ""
    both: Counter = Counter()
    holders: Counter = Counter()
    stands: Counter = Counter()
    free: dict = {}
    for key, text in texts.items():
        text = text or ""
        words = [(m.start(), m.end(), term(m[0])) for m in WORD.finditer(text)]
        base = [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in pii(text)[-1]]
        free[key] = [w for w in words if w[2] and not any(w[0] < e and s < w[1] for _, s, e in base)]
        stands.update({t for _, _, t in words if t})
        found = set()
        for kind, s, e in base:
            value = text[s:e].lower() if kind == "email" else "".join(c for c in text[s:e] if c in "0123456789" or kind == "ip" and c == ".")
            first = max(i for i, w in enumerate(words) if w[0] <= s)
            last = min([i for i, w in enumerate(words) if w[0] >= e], default=len(words))
            near = set(words[max(0, first - reach) : last + reach])
            found |= {((kind, value), t) for a, b, t in near if (a, b, t) in set(free[key])} | {((kind, value), "")}
        both.update(p for p in found if p[1])
        holders.update(p[0] for p in found if not p[1])
    score: dict = {}
    for (entity, t), n in both.items():
        many = stands[t]
        p = (n / many + z * z / 2 / many - z * sqrt(n / many * (1 - n / many) / many + z * z / 4 / many / many)) / (1 + z * z / many)
        if n >= few and p >= least and log2(p * len(texts) / holders[entity]) >= bits:
            score[t] = max(score.get(t, 0), p)
    return {k: [f"{s}:{e}:{'remove' if score[t] >= remove else 'generalise'}" for s, e, t in some if t in score] for k, some in free.items()}


def sanitised(text: str | None, base: list[str], actions: str) -> str:
    """The text with its spans replaced, from the right; of overlapping ones the first counts, then the longest."""
    cuts = [(int(s), int(e), f"[{k.upper()}]") for k, s, e in (x.split(":") for x in base)]
    cuts += [(int(s), int(e), "" if a == "remove" else f"[{c.upper()}]") for s, e, a, c in (x.split(":") for x in actions.split(",") if x)]
    out, taken = [], 0
    for s, e, put in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if s >= taken:
            out.append((s, e, put))
        else:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        taken = max(taken, e)
    text = text or ""
    for s, e, put in reversed(out):
        text = text[:s] + put + text[e:]
    return text


def template(text: str, named: bool, units: frozenset, spelled: dict, no_names: frozenset) -> list[tuple]:
    """[(kind, value, word)] of a text's template words, by the rules of the docstring; word is the first one's number."""
    out: list = []
    edges = EDGES + "«»“”…"
    opens, apart, last = True, True, None
    for k, w in enumerate(WORD.findall(text)):
        bare = w.strip(edges) or w
        low = bare.lower()
        if re.fullmatch(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?", bare):
            kind, value, plain = "num", bare, not bare.endswith("%")
        elif re.fullmatch(r"[+-]?[$€£]?[0-9][0-9.,:/]*[A-Za-z°µ]{1,5}(/[A-Za-z]{1,2})?", bare):
            kind, value, plain = "num", low, False
        elif low in spelled:
            kind, value, plain = "num", spelled[low], True
        elif low not in units and low not in no_names and bare[0].isupper():
            kind, value, plain = ("name" if named or not opens else ""), low, False
        else:
            kind, value, plain = "", low, False
        if not apart and low in units and last == "number":
            out[-1] = ("num", out[-1][1] + low, out[-1][2])
            last = "unit"
        elif not apart and kind == "name" and last == "name":
            out[-1] = ("name", out[-1][1] + " " + value, out[-1][2])
        else:
            out.append((kind, value, k))
            last = "number" if plain else kind
        apart, opens = w[-1] in edges, any(c in ".!?" for c in w[len(w.rstrip(edges)) :])
    return out
