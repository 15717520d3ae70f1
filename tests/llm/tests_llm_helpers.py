"""Brute-force forms of the stages, on dictionaries doc_id -> row."""

from newsflow.llm.simhash import fingerprint
from test_lines import expected as line_expected
from test_suffix import expected as suffix_expected


def line_want(before):
    want = line_expected([(i, r["text"], r["_h"]) for i, r in before.items()])
    return {i: want[i, r["text"]][0] for i, r in before.items()}


def simhash_want(before):
    ids = sorted(before)
    fps = {i: fingerprint(before[i]["text"] or "") for i in ids}
    kept, seen = set(), set()
    for i in ids:
        if i in seen:
            continue
        kept.add(i)
        todo = [i]
        seen.add(i)
        while todo:
            x = todo.pop()
            for j in ids:
                if j not in seen and bin(fps[x] ^ fps[j]).count("1") <= 2:
                    seen.add(j)
                    todo.append(j)
    return kept


def suffix_want(before):
    spans = suffix_expected([(i, r["text"]) for i, r in before.items()])
    out = {}
    for i, r in before.items():
        data, kept, at = r["text"].encode(), b"", 0
        for start, stop in spans[i, r["text"]]:
            while start < stop and data[start] & 0xC0 == 0x80:
                start += 1
            while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
                stop -= 1
            kept += data[at:start]
            at = stop
        out[i] = (kept + data[at:]).decode()
    return out
