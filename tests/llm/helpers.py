import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, percent=80):
    """docs: id -> text; id -> (shingles, smallest id reachable), by all pairs."""
    sets, up = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    meet = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            meet[x].append(i)
    pairs = Counter((a, b) for ids in meet.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(sets[i]), root(i)) for i in docs}


def repeated(docs, least=50):
    """id -> words cut, id -> words of first places, the words, and id -> words of its windows that start in it, by looking every window up."""
    first, where = {}, defaultdict(set)
    tokens = {i: WORD.findall(t or "") for i, t in docs.items()}
    for i in sorted(docs):
        w = tokens[i]
        for a in range(len(w) - least + 1):
            x = tuple(w[a : a + least])
            first.setdefault(x, (i, a))
            where[x].add(i)
    cut, kept, own = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, w in tokens.items():
        for a in range(len(w) - least + 1):
            x = tuple(w[a : a + least])
            if len(where[x]) > 1:
                if first[x][0] != i:
                    cut[i].update(range(a, a + least))
                    continue
                own[i].update(range(a, a + least))
                if first[x] == (i, a):
                    kept[i].update(range(a, a + least))
    return dict(cut), dict(kept), tokens, own
