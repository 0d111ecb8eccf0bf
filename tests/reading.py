"""Field extraction spelled out step by step on plain lists: what the native operator is held against."""

import re

from tallymark import config as C
from tallymark.functions.similarity import ratio

DOB = re.compile(r"\b(\d{1,2}[-/. ](?:\d{1,2}|[A-Za-z]{3,9})[-/. ]\d{2,4})\b")
PIN = re.compile(r"(?<![A-Za-z0-9\-_])([1-9][0-9]{5})\b")
ID = re.compile(r"\b([A-Z]{2,4}[-\s]?[0-9]{6,12})\b")


def match_label(words, names=C.LABELS, least=88.0):
    clean = re.sub(r"[^\w\s]", "", words.lower()).strip()
    for f, labels in names.items():
        if clean and any(clean == n or ratio(clean, n) >= least for n in labels):
            return f
    return None


class Page:
    def __init__(self, rows, gap=18):
        self.tokens, self.lines, last = rows, [], None  # (text, conf, x, y, w, h, line_id)
        for k in sorted(range(len(rows)), key=lambda k: (rows[k][3] // 15, rows[k][2])):
            if last is None or abs(rows[k][3] - last) >= gap:
                self.lines.append([])
            self.lines[-1].append(k)
            last = rows[k][3]
        for line in self.lines:
            line.sort(key=lambda k: rows[k][2])
        self.text = " ".join(r[0] for r in rows)

    def box(self, ks):
        if not ks:
            return (None,) * 4
        r = [self.tokens[k] for k in ks]
        x, y = min(t[2] for t in r), min(t[3] for t in r)
        return x, y, max(t[2] + t[4] for t in r) - x, max(t[3] + t[5] for t in r) - y

    def conf(self, ks, default=None):
        return round(sum(self.tokens[k][1] for k in ks) / len(ks), 3) if ks else default

    def context(self, ks, fallback=()):
        on = {self.tokens[k][6] for k in ks} - {None}
        own = [k for k in range(len(self.tokens)) if self.tokens[k][6] in on] if on else sorted(fallback)
        own.sort(key=lambda k: (self.tokens[k][3] // 15, self.tokens[k][2]))
        return (" ".join(self.tokens[k][0] for k in own) or None, *self.box(own), self.conf(own))


def by_label(page):
    out, text_of = {}, lambda k: page.tokens[k][0]
    for at, line in enumerate(page.lines):
        for k in range(len(line)):
            for n in range(1, min(3, len(line) - k) + 1):
                f = match_label(" ".join(map(text_of, line[k : k + n])))
                if not f or f in out:
                    continue
                value, around = line[k + n :], line
                while value and text_of(value[0]) in (":", "-", ";", "="):
                    value = value[1:]
                if not value and at + 1 < len(page.lines):
                    value = around = page.lines[at + 1]
                value = value[: next((j for j, v in enumerate(value) if match_label(text_of(v))), len(value))]
                raw = re.sub(r"^[:\-\s]+", "", " ".join(map(text_of, value)).strip()).strip()
                if raw:
                    out[f] = (raw, page.conf(value), *page.box(value), "label_proximity", *page.context(value, around))
    return out


def reads_as_date(raw):
    day, month, year = re.split(r"[-/. ]", raw.lower())
    month = int(month) if month.isdigit() else C.MONTHS.get(month, 0)
    year = int(year) + (0 if len(year) > 2 else 2000 if int(year) <= 30 else 1900)
    return 1 <= month <= 12 and 1 <= int(day) <= 31 and 1900 <= year <= 2035


def by_pattern(page, have, doc_type):
    out, everyone = {}, range(len(page.tokens))
    made = lambda raw, ks, conf, method: (raw, conf, *page.box(ks), method, *page.context(ks))
    if "dob" not in have:
        raw = next((m[1].strip() for m in DOB.finditer(page.text) if reads_as_date(m[1].strip())), None)
        if raw:
            ks = [k for k in everyone if page.tokens[k][0] in raw or raw in page.tokens[k][0]]
            out["dob"] = made(raw, ks, page.conf(ks, 0.85), "regex")
    low = page.text.lower()
    if "address" not in have and doc_type != "marksheet" and not any(w in low for w in C.ACADEMIC):
        for m in PIN.finditer(page.text):
            if any(w in page.text[max(0, m.start() - 15) : m.start()].lower() for w in C.PIN_BLOCKERS):
                continue
            k = next((k for k in everyone if m[1] in page.tokens[k][0]), None)
            if k is None:
                continue
            ks = list(range(max(0, k - 8), min(len(page.tokens), k + 2)))
            raw = " ".join(page.tokens[j][0] for j in ks)
            if set(raw.lower().split()) & set(C.ADDRESS_WORDS) or any(w in raw.lower() for w in ("road", "marg", "nagar", "street")):
                out["address"] = made(raw, ks, page.conf(ks), "regex_pin_context")
                break
    if "id_number" not in have and (m := ID.search(page.text)):
        ks = [k for k in everyone if m[1] in page.tokens[k][0] or any(p in page.tokens[k][0] for p in m[1].split())]
        out["id_number"] = made(m[1], ks, page.conf(ks, 0.85), "regex_id")
    return out


def fields(rows, doc_type):
    page = Page(rows)
    found = by_label(page)
    return found | by_pattern(page, set(found), doc_type)
