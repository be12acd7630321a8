"""Plain versions of what the contracts ask, written for clarity."""

from __future__ import annotations

import hashlib
import re

SPACE = r"[^\x20\x09-\x0D]+"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _spans(text: str, rules) -> list[tuple[int, int, int, str]]:
    out = []
    for rank, (kind, pattern, good) in enumerate(rules):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if good(m)]
    return sorted(out)


def pii_base(text: str):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    return _spans(text, (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ))


def secret_base(text: str):
    return _spans(text, (
        ("assign", r"""(?:(?ai:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def rule_counts(text: str | None) -> dict:
    text = text or ""
    words = re.findall(SPACE, text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup, "n_repeat_words": len(repeated),
        "base_failed": len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    }


def shingles(text: str | None) -> set:
    words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in rows}
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and 100 * len(x & y) >= 75 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def decontaminated(text: str | None, items: list[tuple[str, str | None]]) -> tuple[int, int, list[str]]:
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if w else ():
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(item)
    return len(own), len(hit), sorted(found)
