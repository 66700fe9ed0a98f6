"""Chunking and quoted fragments of whole documents against a plain restatement of their rules."""

import hashlib
import re
from bisect import bisect_right

import pytest

from earshot.queries import QUERIES

SF = "/root/testdata/sf0.01"
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\r\x0b\x0c，。！？；：、…“”‘’（）《》【】—～·"
FILLERS = {"zh": {"额", "呃", "噢", "嗯", "呢"}}
ENGLISH = {"um", "uh", "ah", "hmm", "erm", "er", "hm"}
#: Longest duration; least, desired and most tokens of a leaf; desired and most tokens of a parent.
TIERS = [(900, (30, 45, 60), (300, 500)), (2700, (60, 100, 150), (400, 650)), (float("inf"), (150, 200, 250), (520, 800))]
TOKEN = re.compile("[㐀-鿿]|[^\\s㐀-鿿]+")


def tokens(text):
    return len(TOKEN.findall(text))


def transcript(text):
    """Lines as (text, start, end, [(word, start, end)]), 0.4 s a word."""
    out, before = [], 0
    for line in (text or "").split("\n"):
        words = re.findall(r"[^ \t-\r]+", line)
        if words:
            start, end = before * 400 / 1000, (before + len(words)) * 400 / 1000
            out.append((" ".join(words), start, end, [(w, start + i * 0.4, start + (i + 1) * 0.4) for i, w in enumerate(words)]))
            before += len(words)
    return out


def cleaned(lines, lang):
    out = []
    for _, start, end, words in lines:
        kept = [w for w in words if w[0].strip(STRIP).lower() not in FILLERS.get(lang, ENGLISH)]
        if kept:
            out.append((("" if lang == "zh" else " ").join(w[0] for w in kept), start, end, kept))
    return out


def split(line, most, joiner):
    text, start, end, words = line
    parts = min(max(-(-tokens(text) // most), -int(-(end - start) // 360)), len(words))
    if parts < 2:
        return [line]
    begins, at = [], 0
    for w, _, _ in words:
        begins.append(at)
        at += len(w) + len(joiner)
    own = [0] * (len(words) + 1)
    for m in TOKEN.finditer(joiner.join(w[0] for w in words)):
        own[bisect_right(begins, m.start() + len(joiner))] += 1
    total = [sum(own[:i + 1]) for i in range(len(words) + 1)]
    share, cuts, i = total[-1] / parts, [0], 1
    for k in range(1, parts):
        off = lambda x: abs(total[x] - k * share)
        stop = next((j for j in range(i, len(words) - 1) if off(j + 1) > off(j)), None)
        if stop is None:
            break
        ends = [j for j in range(i, stop + 1) if words[j - 1][0].strip()[-1:] in set("。！？；.!?;") and off(j) <= share * 0.15]
        cuts.append(ends[-1] if ends and ends[-1] > cuts[-1] else stop)
        i = stop + 1
    return [(joiner.join(w[0] for w in words[a:b]), words[a][1], words[b - 1][2], words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)])]


def runs(items, desired, most, least=0, seconds=0.0):
    """Indices of the items (tokens, start, end) of each run."""
    out = []
    for i, (n, _, end) in enumerate(items):
        if out:
            own = [items[j] for j in out[-1]]
            have = sum(x[0] for x in own)
            over = have + n > most or end - own[0][1] > 360 or abs(desired - have) < abs(desired - have - n)
            if over and have >= least and own[-1][2] - own[0][1] >= seconds:
                out.append([])
        else:
            out.append([])
        out[-1].append(i)
    return out


def leaves(lines, lang, seconds):
    _, (least, desired, most), parent = next(t for t in TIERS if seconds <= t[0])
    joiner = " " if (lang or "en").lower() == "en" else ""
    pieces = []
    for line in lines:
        long = tokens(line[0]) > most or line[2] - line[1] > 360
        pieces += split(line, most, joiner) if long else [line]
    sizes = [(tokens(p[0]), p[1], p[2]) for p in pieces]
    out = []
    for run in runs(sizes, desired, most, least, 10.0):
        own = [pieces[i] for i in run]
        words = [w for p in own for w in p[3]]
        out.append((joiner.join(p[0].strip() for p in own), words[0][1], words[-1][2], sum(sizes[i][0] for i in run), len(run)))
    groups = runs([(tokens(c[0]), c[1], c[2]) for c in out], *parent)
    return out, groups, joiner


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def close(rows):
    return sorted((*r[:2], *(round(x, 6) if isinstance(x, float) else x for x in r[2:])) for r in rows)


def test_chunks_of_whole_documents(spark, documents):
    wanted, parents = [], []
    for doc, text, lang in documents:
        lines = transcript(text)
        kept = cleaned(lines, lang)
        if not kept:
            continue
        own, groups, joiner = leaves(kept, lang, lines[-1][2])
        of = {i: p for p, g in enumerate(groups) for i in g}
        wanted += [(doc, i, md5(c[0]), c[1], c[2], c[3], c[4], of[i]) for i, c in enumerate(own)]
        parents += [(doc, p, own[g[0]][1], own[g[-1]][2], len(g), md5(joiner.join(own[i][0] for i in g))) for p, g in enumerate(groups)]
    got = QUERIES["chunk_leaf"](spark, SF).select("episode_id", "chunk_no", "text", "start", "end", "tokens", "segments", "parent_no").collect()
    assert close(got) == close(wanted)
    got = QUERIES["chunk_parent"](spark, SF).select("episode_id", "parent_no", "start", "end", "leaf_indices", "text").collect()
    assert close(got) == close(parents)


def test_whole_documents_as_one_segment(spark, documents):
    wanted = []
    for doc, text, lang in documents:
        lines = transcript(text)
        if lines:
            whole = (" ".join(x[0] for x in lines), 0.0, lines[-1][2], [w for x in lines for w in x[3]])
            own, groups, _ = leaves([whole], lang, lines[-1][2])
            of = {i: p for p, g in enumerate(groups) for i in g}
            wanted += [(doc, i, c[1], c[2], c[3], c[4], of[i]) for i, c in enumerate(own)]
    got = QUERIES["oversize_split"](spark, SF).select("episode_id", "chunk_no", "start", "end", "tokens", "segments", "parent_no").collect()
    assert close(got) == close(wanted)


def plain(text):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if not c.isspace() and unicodedata.category(c)[0] != "P")


def test_fragments_by_their_longest_part(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    wanted = []
    for doc, text in texts.items():
        lines = transcript(text)
        if not lines:
            continue
        said = [plain(x[0]) for x in lines]
        whole, asked = "".join(said), plain(lines[len(lines) // 2][0] + " qx qx")
        row = (str(doc), False, None, None, None)
        for size in range(len(asked), 0, -1):
            at = [p for p in (whole.find(asked[i:i + size]) for i in range(len(asked) - size + 1)) if p >= 0]
            if at or size - 1 < 0.7 * len(asked):
                break
        if at and whole and size >= 0.7 * len(asked):
            ends = [sum(map(len, said[:i + 1])) for i in range(len(said))]
            hit = [i for i, e in enumerate(ends) if e > min(at) and e - len(said[i]) < min(at) + size]
            own = lines[hit[0]:hit[-1] + 1]
            row = (str(doc), True, md5(" ".join(x[0] for x in own)), round(own[0][1], 6), round(own[-1][2], 6))
        wanted.append(row)
    got = [(r.key, r.found, r.text, r.start and round(r.start, 6) or r.start, r.end and round(r.end, 6)) for r in QUERIES["find_timestamp_fuzzy"](spark, sf).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str) and any(r[1] for r in wanted)
