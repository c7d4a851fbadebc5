"""Personal data: four kinds by pattern, and more of them by a character BiLSTM with CRF transitions.

The tagger is trained in numpy on spans that the patterns label in a bounded sample (`sample` texts with a digit or @,
by lowest hash of the id; `windows` windows of their characters), as they stand and disturbed: other separators, dots
in brackets, blanks inside, full-width digits, phones without their plus. So it finds what the patterns do not. It reads
windows of WINDOW characters that overlap by half; where windows overlap, their emissions are averaged, the more central
counting more, and each stretch of windows is decoded as one. Every kind holds a digit or @, so characters more than
half a window away from any are outside spans by definition and need no window. Its spans are added where they meet none
of the patterns' and have the form of their kind: email an @ between other characters, ip four numbers up to 255 with dots,
card 13 to 19 digits in groups that pass Luhn, phone 9 to 15 digits with a plus before them or an area code in brackets.

A null or empty text has no spans. Null keys and repeated rows stay, each on its own. Without labelled spans only the
patterns speak. Empty tables give no rows; other columns are not read by `personal_data`, and kept by `masked`.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .char_tagger import Tagger, classes_of
from .learning import lowest_hashes, sample_texts
from .text_arrays import slices

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
#: Bytes of text that a task reads at once.
SLICE = 1 << 19
_TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of every kind

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: The given patterns, written so that a run of characters is tried once and not from each of its places.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGNAL = re.compile("[0-9@\uff10-\uff19\uff20]")
_WIDE = {c: c + 0xFEE0 for c in b"0123456789@"}
_NARROW = {c + 0xFEE0: c for c in range(0x21, 0x7F)}
#: Forms of spans the tagger may add, over narrowed texts.
_EMAIL_FORM = re.compile(r"[^\s@]+@[^\s@]+|[^\s@]+ @ [^\s@]+\.[^\s@]+")
_IP_FORM = re.compile(r"[0-9]{1,3}(?:(?: \. |[\[(]\.[\])]|\.)[0-9]{1,3}){3}")
_CARD_FORM = re.compile(
    r"[0-9]{4}([^0-9A-Za-z]{0,3})(?:[0-9]{4}\1){2}[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([^0-9A-Za-z]{0,3})[0-9]{6}\2[0-9]{5}"
)
_PHONE_FORM = re.compile(r"\+[ (]{0,2}[0-9](?:[^0-9A-Za-z]{0,3}[0-9])*")
_AREA_FORM = re.compile(r"[0-9]{1,3} ?\([0-9]{3,4}\) ?[0-9]{3,4}[ .-]?[0-9]{4}")


def _emails(text: str):
    free = 0  # a match begins here or later
    for found in _DOMAIN.finditer(text):
        # The characters before the @: no further back than the last @ or the last match.
        at = found.start()
        back = max(free, text.rfind("@", free, at) + 1)
        piece = text[back:at]
        name = len(piece) - len(piece.rstrip(_LOCAL))
        if name:
            yield at - name, found.end()
        free = found.end() if name else at + 1


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the given patterns, by kind and start."""
    if not _SIGNAL.search(text):
        return []
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, m.start(), m.end()))
    spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return spans


def _stretches(text: str) -> list[tuple[int, int]]:
    """Ranges within half a window of a digit or @, joined where they meet."""
    out: list[list[int]] = []
    for m in _SIGNAL.finditer(text):
        a, b = max(0, m.start() - WINDOW // 2), min(len(text), m.start() + WINDOW // 2)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _windows(length: int) -> range:
    """Starts of the windows over a stretch."""
    return range(0, max(1, length - WINDOW // 2), WINDOW // 2)


def _cut(ids: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, ids.dtype)
    part = ids[start : start + WINDOW]
    out[: len(part)] = part
    return out


def _disturbed(kind: int, span: str, rng: np.random.Generator) -> str:
    """The span as the patterns do not know it."""
    way, digits = rng.integers(4), _digits(span)
    if way == 0:
        return span.translate(_WIDE)
    if kind == 0:
        name, host = span.split("@")
        return f"{name} @ {host}" if way == 1 else f"{name}@{host.replace('.', '[.]' if way == 2 else '(.)')}"
    if kind == 1:
        return span.replace(".", ("[.]", "(.)", " . ")[way - 1])
    if kind == 2:
        return rng.choice([".", "/", "_", "  ", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if way == 1:
        return re.sub(r"[\x20().-]+", rng.choice(["/", "_", " / "]), span)
    if way == 2:
        return "+ " + span[1:]
    return f"{digits[:-10] or 1} ({digits[-10:-7] or '00'}) {digits[-7:-4]}-{digits[-4:]}"


def disturb(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans disturbed, and where they stand now; of spans that meet, the first."""
    out, spans, last, size = [], [], 0, 0
    for kind, a, b in sorted(base_spans(text), key=lambda s: (s[1], s[0])):
        if a < last:
            continue
        new = _disturbed(kind, text[a:b], rng)
        size += a - last
        out += [text[last:a], new]
        spans.append((kind, size, size + len(new)))
        size, last = size + len(new), b
    return "".join([*out, text[last:]]), sorted(spans)


def labelled_windows(text: str, spans: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows (classes, tags) of a text; tags by the given spans or the patterns, the first kind that claims a character."""
    ids, tags = classes_of(text), np.zeros(len(text), np.int64)
    for kind, a, b in reversed(base_spans(text) if spans is None else spans):
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return [(_cut(ids[a:b], s), _cut(tags[a:b], s)) for a, b in _stretches(text) for s in _windows(b - a)]


def allowed_steps() -> np.ndarray:
    """Inside follows begin or inside of its kind only."""
    ok = np.ones((_TAGS, _TAGS), bool)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


def learn_tagger(docs: DataFrame, sample: int = 600, windows: int = 1500, key: str = "doc_id"):
    """The trained tagger, or None where the sample has no spans."""
    ids = docs.where(F.col(key).isNotNull() & F.col("text").rlike("[0-9@]")).select(F.col(key).cast("long").alias("id")).distinct()
    texts = sample_texts(docs, lowest_hashes(ids, sample).withColumn("group", F.lit(1)), "private")

    def cut(batches):
        for batch in batches:
            for number, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found = labelled_windows(text or "")
                if any(t.any() for _, t in found):
                    found += [w for w in labelled_windows(*disturb(text, np.random.default_rng(number % (1 << 63)))) if w[1].any()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()),
                        pa.array([int(t.any()) for _, t in found], pa.int32()),
                        pa.array([i.astype(np.uint8).tobytes() for i, _ in found], pa.binary()),
                        pa.array([t.astype(np.uint8).tobytes() for _, t in found], pa.binary()),
                    ],
                    ["id", "place", "marked", "classes", "tags"],
                )

    cuts = stage_windows(texts.mapInArrow(cut, "id long, place int, marked int, classes binary, tags binary"))
    # Windows with spans first, half of all at least for those without.
    chosen = [cuts.where(F.col("marked") == m).orderBy(F.xxhash64("id", "place"), "id", "place").limit(windows if m else windows // 2).toArrow() for m in (1, 0)]
    if not chosen[0].num_rows:
        return None
    both = pa.concat_tables(chosen)
    read = lambda name: np.frombuffer(b"".join(both.column(name).to_pylist()), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    return Tagger(_TAGS).fit(read("classes"), read("tags"))


def stage_windows(rows: DataFrame) -> DataFrame:
    from ..operators.staging import stage

    return stage(rows, "windows")


def _well_formed(kind: int, text: str) -> bool:
    text = text.translate(_NARROW)
    digits = _digits(text)
    if kind == 0:
        return _EMAIL_FORM.fullmatch(text) is not None
    if kind == 1:
        return _IP_FORM.fullmatch(text) is not None and all(int(x) <= 255 for x in re.findall(r"[0-9]+", text))
    if kind == 2:
        return 13 <= len(digits) <= 19 and _CARD_FORM.fullmatch(text) is not None and _luhn(digits)
    return 9 <= len(digits) <= 15 and (_PHONE_FORM.fullmatch(text) or _AREA_FORM.fullmatch(text)) is not None


def all_spans(texts: list[str], tagger) -> list[tuple[list, list]]:
    """Per text: the patterns' spans, and all spans, each by kind and start."""
    bases = [base_spans(t) for t in texts]
    if tagger is None:
        return [(b, b) for b in bases]
    places = [(i, a, b) for i, t in enumerate(texts) if _SIGNAL.search(t) for a, b in _stretches(t)]
    found: list[list] = [list(b) for b in bases]
    weight = (np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW))).astype(np.float32)[:, None]
    for first in range(0, len(places), 256):
        part = places[first : first + 256]
        stretches = [classes_of(texts[i][a:b]) for i, a, b in part]
        starts = [(n, s) for n, ids in enumerate(stretches) for s in _windows(len(ids))]
        sums = [np.zeros((len(ids), _TAGS), np.float32) for ids in stretches]
        weights = [np.zeros((len(ids), 1), np.float32) for ids in stretches]
        for at in range(0, len(starts), 1024):
            some = starts[at : at + 1024]
            scores = tagger.emissions(np.stack([_cut(stretches[n], s) for n, s in some]))
            for (n, s), score in zip(some, scores):
                size = min(WINDOW, len(stretches[n]) - s)
                sums[n][s : s + size] += (score * weight)[:size]
                weights[n][s : s + size] += weight[:size]
        tags = tagger.decode([x / w for x, w in zip(sums, weights)], allowed_steps())
        for (i, a, _), line in zip(part, tags):
            begins = np.flatnonzero(line % 2 == 1)
            for p in begins.tolist():
                kind = int(line[p]) // 2
                q = p + 1
                while q < len(line) and line[q] == 2 + 2 * kind:
                    q += 1
                start, end = a + p, a + q
                piece = texts[i][start:end]
                start, end = start + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip()))
                taken = any(x < end and start < y for _, x, y in found[i])
                if start < end and not taken and _well_formed(kind, texts[i][start:end]):
                    found[i].append((kind, start, end))
    return [(b, sorted(f)) for b, f in zip(bases, found)]


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, key: str = "doc_id", **bounds) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; counts and digest of the patterns' spans."""
    tagger = learn_tagger(docs, key=key, **bounds)

    def find(batches):
        for batch in slices(batches, "text", SLICE):
            both = all_spans([t or "" for t in batch.column("text").to_pylist()], tagger)
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in both], pa.int64()) for kind in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in both], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *counts, digests, pa.array([_written(every) for _, every in both], pa.string())],
                [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(find, f"`{key}` long, {columns}, base_sha256 string, spans string")


def masked(docs: DataFrame, **bounds) -> DataFrame:
    """The documents with all their columns; every span of `text` is its kind in brackets, and n_chars, where there is
    such a column, counts the new text. Narrow, no shuffle."""
    tagger = learn_tagger(docs, **bounds)
    names = docs.columns

    def mask(batches):
        for batch in slices(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            new = []
            for text, (_, spans) in zip(texts, all_spans([t or "" for t in texts], tagger)):
                last, out = 0, []
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if b <= last:
                        continue
                    out += [text[last : max(a, last)], f"<{KINDS[kind]}>" if a >= last else ""]
                    last = b
                new.append(text if text is None or not out else "".join([*out, text[last:]]))
            batch = batch.set_column(names.index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
            if "n_chars" in names:
                field = batch.schema.field("n_chars")
                lengths = pa.array([o if t == s else len(s) for t, s, o in zip(texts, new, batch.column("n_chars").to_pylist())], field.type)
                batch = batch.set_column(names.index("n_chars"), field, lengths)
            yield batch

    return docs.mapInArrow(mask, docs.schema)
