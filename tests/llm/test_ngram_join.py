import itertools

from quarry.llm.ngram_join import ngram_jaccard_join


def brute(rows):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if find(j) == find(i) and rows[j].doc_id is not None]
        out.append((r.doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def test_components_equal_brute_force(documents):
    rows = documents.collect()
    got = sorted((tuple(r) for r in ngram_jaccard_join(documents).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_empty_table(documents):
    assert ngram_jaccard_join(documents.limit(0)).collect() == []


def test_sets_whose_numbers_clash_stay_apart(documents):
    rows = documents.collect()
    got = sorted((tuple(r) for r in ngram_jaccard_join(documents, bits=5).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)
