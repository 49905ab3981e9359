"""Slow, plain versions of the operators for small tables."""

import hashlib
import itertools
import re

from duecast.llm import quality_rules, secret_scan

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def figures(text):
    words, lines = SPACE.findall(text or ""), [x for x in (text or "").split("\n") if SPACE.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    stop = {w for group in quality_rules.STOP_WORDS.values() for w in group}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_stop_words": sum(w.lower() in stop for w in words),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def kept(text):
    f = figures(text)
    if f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]:
        return False
    for rule in quality_rules.THRESHOLDS:
        figure, per = (100 * f[rule.figure], f[rule.per]) if rule.per else (f[rule.figure], 1)
        if (rule.least is not None and figure < rule.least * per) or (rule.most is not None and figure > rule.most * per):
            return False
    return True


def shingles(text, n=3):
    words = SPACE.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def components(rows, n=3, percent=90):
    """Smallest number of each row's component, rows as (doc_id, text)."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            root[top(a)] = top(b)
    return [(d, len(sets[i]), min(rows[j][0] for j in range(len(rows)) if top(j) == top(i))) for i, (d, _) in enumerate(rows)]


def windows(items):
    out = set()
    for _, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        out |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    return out


def contaminated(text, known):
    words = ALNUM.findall((text or "").translate(LOWER))
    return any(tuple(words[i : i + n]) in known for n in {len(w) for w in known} for i in range(len(words) - n + 1))


def removed(rows):
    """doc_id -> (bytes, removed, spans, digest) for rows (doc_id, text) in order of number."""
    seen, out = set(), {}
    for number, text in sorted(rows):
        raw = (text or "").encode()
        covered = [False] * len(raw)
        for i in range(len(raw) - 99):
            piece = raw[i : i + 100]
            if piece in seen:
                covered[i : i + 100] = [True] * 100
            seen.add(piece)
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out[number] = (len(raw), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(raw, covered, strict=True) if not c)).hexdigest())
    return out


def secrets(rows):
    """Findings (start, kind, end, value) per row of (doc_id, text, owner) and the owners of each value."""
    found, owners = [], {}
    for number, text, owner in rows:
        mine = []
        for kind, (pattern, group, least, shows) in secret_scan.KINDS.items():
            for m in re.finditer(pattern, text or ""):
                value = m.group(group)
                if len(value) >= least and all(re.search(s, value) for s in shows):
                    mine.append((m.start(), list(secret_scan.KINDS).index(kind), m.end(), kind, value))
                    owners.setdefault(value, set()).add(owner or "")
        found.append((number, sorted(mine)))
    return [(n, [f for f in fs if f[3] in secret_scan.BASE_KINDS or len(owners[f[4]]) == 1]) for n, fs in found], owners
