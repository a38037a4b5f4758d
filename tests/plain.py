"""Plain versions of the parsers of long documents, one line after another."""

import re

from corpusloom.functions import tables as T
from corpusloom.operators.scan import fold  # noqa: F401

HEAD = re.compile(r"^([0-9]?\s?[A-ZÁÉÍÓÚ ]+?)\s+([0-9]+)(?:,\s*([0-9]+))?\s*$")
HEADING = re.compile(r"^#\s+([0-9]?\s?[A-ZÁÉÍÓÚ ]+)\s*$")
MARK = re.compile(r"([⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:-[⁰¹²³⁴⁵⁶⁷⁸⁹]+)?)|(?:(?<=[\s.?!:;)])|^)(200|1[0-9]{2}|0?[1-9][0-9]|0{0,2}[1-9])\s+(?=[A-ZÁÉÍÓÚÑ])")
OT_MARK = re.compile(r"(?:^|(?<=[\s.?!:;)]))(200|1[0-9]{2}|0?[1-9][0-9]|0{0,2}[1-9])\s+(?=[A-ZÁÉÍÓÚÑ¿¡])")


def verses(text):
    """(libro, capitulo, versiculo, texto, combined) of a scanned New Testament."""
    book = chapter = None
    seen, found = set(), []

    def content(line):
        if book is None:
            return
        marks = list(MARK.finditer(line))
        pieces = [line[: marks[0].start()] if marks else line]
        pieces += [line[m.end() : n.start() if n else None] for m, n in zip(marks, [*marks, None][1:], strict=True)]
        for piece, m in zip(pieces, [None, *marks], strict=True):
            if m:
                found.append([book, chapter, (m[1] or m[2]).translate(str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")), []])
            if found and piece.strip():
                found[-1][3].append(piece.strip())

    for line in (x.rstrip() for x in text.splitlines()):
        if line == "" or re.match(r"^<!--\s*Page\s+\d+\s*-->\s*$", line) or (re.match(r"^\s*\d+\s*$", line) and len(line.strip()) <= 4) or ("Wycliffe" in line and "©" in line) or re.match(r"^#{2,}\s+", line):
            continue
        was = book, chapter
        if m := HEAD.match(line):
            name = re.sub(r"\s+", " ", m[1].strip().upper())
            now = T.NT_ALIASES.get(name) or next((b for a, b in T.NT_ALIASES.items() if a in name or name in a), None)
            if now is None:
                content(line)
                continue
            book, chapter = now, int(m[3] or m[2])
        elif line.lstrip().startswith("#"):
            m = HEADING.match(line)
            if not m:
                continue
            name = re.sub(r"\s+", " ", m[1].strip().upper())
            ways = T.NT_AMBIGUOUS.get(name)
            now = next((b for b in ways if b not in seen), None) if ways else T.NT_ALIASES.get(name)
            if now is None:
                continue
            book, chapter = now, 1 if now != book else chapter
        else:
            content(line)
            continue
        seen.add(book)
        if (book, chapter) != was:
            found.append([book, chapter, None, []])
    out = []
    for b, c, mark, texts in found:
        if mark and texts:
            a, z = int(mark.split("-")[0]), int(mark.split("-")[-1])
            numbers = [a] if "-" not in mark else range(a, z + 1) if 0 < a <= z < 200 else []
            out += [(b, c, n, " ".join(texts), "-" in mark) for n in numbers]
    return out


def old_testament(text):
    """(libro, capitulo, versiculo, texto) with at least three words."""
    book, chapter, most, current, found = None, 1, 0, None, []
    for line in (x.rstrip() for x in text.splitlines()):
        m = re.match(r"^\s+([A-ZÁÉÍÓÚ0-9 ]+)\s*$", line)
        name = re.sub(r"\s+", " ", m[1].strip()) if m else None
        now = (T.OT_ALIASES.get(name) or next((b for a, b in T.OT_ALIASES.items() if a in name), None)) if name else None
        bare = line.strip()
        if now:
            book, chapter, most, current = now, 1, 0, None
        elif book is None or not bare:
            continue
        elif bare.isdigit() and 1 <= int(bare) <= 200:
            if int(bare) > chapter:
                chapter, most, current = int(bare), 0, None
        elif "Wycliffe" in line or "Pasajes del Antiguo" in line or re.match(r"^\s+[A-ZÁÉÍÓÚ][^a-záéíóú\d]{6,}$", line):
            continue
        else:
            marks = list(OT_MARK.finditer(line))
            if current is not None:
                current[3].append(line[: marks[0].start()].strip() if marks else bare)
            for m, after in zip(marks, [*marks, None][1:], strict=True):
                n = int(m[1])
                if n < most - 5:
                    chapter, most = chapter + 1, 0
                most = max(most, n)
                current = [book, chapter, n, [line[m.end() : after.start() if after else None].strip()]]
                found.append(current)
    rows = [(b, c, n, " ".join(t for t in texts if t)) for b, c, n, texts in found]
    return [r for r in rows if len(r[3].split()) >= 3]


class Blocks:
    article = re.compile(r"^#+\s+SUG SUIUCHII\s*\((\d+)\)\s*/\s*Art[íi]culo\s+(\d+)", re.IGNORECASE)
    number = re.compile(r"^\s*(\d+)\.\s+(.+?)\s*$")
    aside = re.compile(r"^\s*(//|\")")

    def __init__(self, lines_):
        self.lines = lines_

    def target(self, at, stop_at_article):
        """The block of lines from the first that isn't blank, joined, and where it ends; empty if an aside comes first."""
        while at < len(self.lines) and not self.lines[at].strip():
            at += 1
        first, parts = at, []
        while at < len(self.lines):
            line = self.lines[at]
            ends = not line.strip() or self.aside.match(line) or (self.number.match(line) and (parts or stop_at_article)) or (stop_at_article and self.article.match(line))
            if ends:
                break
            parts.append(line.strip())
            at += 1
        return " ".join(parts), at if parts else first

    def pairs(self):
        article, at = None, 0
        while at < len(self.lines):
            line = self.lines[at]
            if m := self.article.match(line):
                article = int(m[2])
            elif article is not None and (m := self.number.match(line)):
                text, end = self.target(at + 1, stop_at_article=False)
                if text:
                    yield article, int(m[1]), m[2].strip(), text
                at = end
                continue
            elif article is not None and line.strip() and not self.aside.match(line):
                text, end = self.target(at + 1, stop_at_article=True)
                if len(line.split()) >= 3 and len(text.split()) >= 3:
                    yield article, 0, line.strip(), text
                    at = end
                    continue
            at += 1


def report(text):
    """(seq, kind, level, number, text, title, header, cells) of a report's lines, in their order."""
    lines = [(i, x.rstrip()) for i, x in enumerate(text.split("\n"))]
    left = [(i, x) for i, x in lines if x]
    found, caption, tables = [], None, {}
    for i, x in left:
        here, caption = caption, None
        # here: the caption right before this line, and whether it may still get a title.
        if here and here[1] and len(x.strip()) > 2 and x.strip()[0] == x.strip()[-1] == "*":
            here[0][5] = x.strip()[1:-1]
            caption = here[0], False
        elif m := re.fullmatch(r"(#+)\s+(.+)", x):
            found.append([i, "heading", len(m[1]), None, m[2], None, None, None])
        elif m := re.fullmatch(r"\*\*(Tabla|Figura)\s+(\d+)\*\*", x):
            found.append([i, "caption", None, int(m[2]), m[1], None, None, None])
            caption = found[-1], True
        elif m := re.fullmatch(r"!\[.*?\]\((.+)\)", x):
            own = here[0] if here and here[0][4] == "Figura" else [None] * 8
            found.append([i, "figure", None, own[3], m[1], own[5], None, None])
        elif m := re.fullmatch(r"\*Nota\.\*\s*(.+)", x):
            found.append([i, "note", None, None, m[1], None, None, None])
        elif re.fullmatch(r"\|.+\|", x):
            cells = [c.strip() for c in x.strip("|").split("|")]
            if i - 1 in tables:
                tables[i] = tables[i - 1]
                tables[i][1].append(cells)
            else:
                tables[i] = (here[0] if here and here[0][4] == "Tabla" else [None] * 8), [cells], i
        elif m := re.fullmatch(r"[-*]\s+(.+)", x):
            found.append([i, "list", None, None, m[1], None, None, None])
        else:
            found.append([i, "paragraph", None, None, x, None, None, None])
    for own, rows, i in {id(t): t for t in tables.values()}.values():
        if len(rows) > 1:
            found.append([i, "table", None, own[3], None, own[5], rows[0], rows[2:]])
    return sorted(found, key=lambda r: r[0])
