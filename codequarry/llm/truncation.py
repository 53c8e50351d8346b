"""Text cut off by field limits or mid-transfer.

Each text runs through a stack automaton over its structure: fences, inline code, brackets, quotes, string and comment states
of code, broken multibyte sequences and escapes, marks of omission.  What the automaton finds open at the end of the text is the first
reason; what it finds closed, but without a terminator, is held against baselines computed over *all* documents:

* per source and kind: how many of its texts end with a terminator; where few do, a missing one says nothing by itself;
* per source: the length at which its texts pile up (in characters or bytes), and how the length it claims relates to the
  length that arrived;
* per word: how often it ends a line, and how often the word after it does, to tell a line that may end there from one that
  stops mid-phrase or mid-word where the kind of line (list item, subject, title) has no terminator.

Null, blank and naturally short texts are no cases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.plans.workspace import materialised

#: A source has a field limit if at least this share of its texts (and this many) have exactly its greatest length.
LIMIT_SHARE, LIMIT_ROWS = 0.01, 3
#: A source's claimed length may follow any rule that at least this share of its texts obeys.
CLAIM_SHARE = 0.05
#: A word seen this often is known; known words end lines in at least FINAL_SHARE of their uses if a line may end with them.
#: A word of COMMON_WORD uses that ends lines in less than FINAL_SHARE of them may not end one; cut texts make up some of these ends.
KNOWN_WORD, FINAL_SHARE, COMMON_WORD = 5, 0.004, 50
#: The word after a given one ends the line in at least this share of cases if the line may end there.
FOLLOW_SHARE = 0.03

#: Texts of a source and kind use terminators if at least this share of them (of TERMINATED_ROWS or more, else of the kind) ends with one.
TERMINATED_SHARE, TERMINATED_ROWS = 0.2, 20

_MARKS = re.compile(r"\s*(?:\(\s*(?:truncated|continued|cut|more|shortened|abridged)\s*\)|\[\s*(?:\.\.\.|…|truncated|cut|snip|more)\s*\]|<\s*(?:truncated|snip)\s*>)\s*$", re.I)
_DOTS = re.compile(r"\s*(?:…|\.\.\.)\s*$")
_BROKEN = re.compile(r"(?:\ufffd|[\ud800-\udfff]|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|(?<!\\)\\|&#?[A-Za-z0-9]{1,6}|%[0-9A-Fa-f]?)\Z")
_ENTITY = re.compile(r"&(?:#\d*|[a-z]{1,3})\Z")
#: Marks of omission, escapes and the like are shorter than this.
END = 400
_ENTITY_TAIL = re.compile(r"&#?[A-Za-z0-9]{1,6}\Z|%[0-9A-Fa-f]?\Z")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
#: A fence opens at the end of a line, also behind other words; it closes at the start of one, whatever follows.
_FENCES = re.compile(r"(^ {0,3})?(```+|~~~+)([\w+#.-]*[ \t\r]*$)?", re.M)
_ITEM = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]|\d+[.)])\s+")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ])?\[?\d\d:\d\d(?::\d\d)?(?:[.,]\d+)?\]?Z?\s+(?:\w+\s+)?(?:[\w.-]+:\s*)?")
_STOP = re.compile(r"[.!?。！？][\"'”’)\]`*_]*(?=\s|$)")
_WORD = re.compile(r"[^\W_]+(?:[_'’-][^\W_]+)*")
_CODE_TOKEN = re.compile(
    r"\"\"\"|'''|/\*|\*/|//[^\n]*|#[^\n{}()\[\]]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){1,2}'|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[\"`]|[(){}\[\]]|\n", re.S
)
#: A last line of two sentences at least that is neither a comment nor a string: prose, whatever the kind says.
_PROSE_END = re.compile(r"(?:^|\n)[A-Z][^\n\"'{};]*[a-z`]{2,}[.!?] [A-Z][^\n\"{};]*[.!?]\s*\Z")
_OPEN = {")": "(", "]": "[", "}": "{"}
_PY_HEAD = re.compile(r"^\s*(?:(?:async\s+)?def\s+\w+\s*\(|class\s+\w+[^{;]*:\s*$|from\s+[\w.]+\s+import\s|import\s+[\w.]+\s*$)", re.M)
_BRACE_LINE = re.compile(r"[{;][ \t\r]*$", re.M)
_FULL_LINE = re.compile(r"^.*\S.*$", re.M)
#: A call for attention before a line that otherwise starts small ("Note: ", "FYI, ").
_CALL = re.compile(r"^[A-Z][\w-]{0,9}[:,][ \t]+(?=[a-z])")
_PY_STATEMENT = re.compile(r"^(return|raise|pass|break|continue|yield|if|for|while|with|try|except|else|elif|finally|def|class|import|from|assert|del|global|async|@)\b")


def code_state(text: str) -> str:
    """'open' if a bracket, string or comment is open at the end of ``text``, else '' ."""
    stack: list[str] = []
    inside = ""
    for match in _CODE_TOKEN.finditer(text):
        token = match[0]
        if inside:
            if token == inside or (inside == "*/" and token.endswith("*/")):
                inside = ""
            continue
        if token in ('"""', "'''"):
            inside = token
        elif token == "/*":
            inside = "*/"
        elif token in ('"', "`"):
            return "open" if token == "`" or "\n" not in text[match.end() :] else ""
        elif token in "([{":
            stack.append(token)
        elif token in ")]}" and stack and stack[-1] == _OPEN[token]:
            stack.pop()
    return "open" if stack or inside else ""


def is_python(text: str) -> bool:
    """Whether program text has a Python head, and hardly a line that ends like one of a brace language."""
    return bool(_PY_HEAD.search(text)) and len(_BRACE_LINE.findall(text)) * 10 <= len(_FULL_LINE.findall(text))


def looks_like_code(text: str) -> bool:
    """Whether a whole text is program text: most lines end or begin like code and hardly any like a sentence."""
    lines = [x for x in text.split("\n") if x.strip()]
    marks = sum(1 for x in lines if re.search(r"[{};]\s*$|^\s*(?:def|class|fn|func|function|import|from|use|pub|return|package|public|private|export|const|let|if|for|while)\b.*[({:;=\w]\s*$|^\s+[\w.\[\]]+\s*(?:=|:=|\+=)\s*\S|[(\[,]\s*$|^\s*[)\]}]+[,;]?\s*$", x))
    return len(lines) > 0 and marks * 2 >= len(lines) and not any(_FENCE.match(x) for x in lines)


def _code_end(text: str, kind: str | None) -> tuple[str, str, str]:
    """(state, word, before) of program text."""
    if code_state(text):
        return "structure", "", ""
    body = text.rstrip()
    last = body[body.rfind("\n") + 1 :]
    if is_python(text):
        if text[len(body) :].strip("\r\n"):
            return "space", "", ""
        if last.lstrip().startswith("#"):
            return "structure", "", ""
        head = _PY_STATEMENT.match(last.lstrip())
        return "line", f"py:{head[1] if head else 'other'}:{'deep' if last[:1] in ' \t' else 'top'}", ""
    return ("ended", "", "") if re.search(r"[}\])];?,?\s*$|;\s*$|\*/\s*$|>\s*$", last) and not re.match(r"\s*(?://|\*)", last) else ("structure", "", "")


def examine(text: str | None, kind: str | None = None) -> tuple[str, str, str]:
    """(state, word, before) at the end of a text.

    States: '' (null or blank), 'broken', 'marked' (an explicit mark of omission), 'structure' (something open, or a sign that something has
    to follow), 'sentence' (a sentence without terminator), 'space' (stops after a blank), 'dots' (ends in an ellipsis), 'title' (a heading without a text), 'word' (no terminator is due:
    decide by the last word and the one before), 'line' (code: decide by the kind of the last line), 'ended'.
    """
    if text is None or not text.strip():
        return "", "", ""
    last, full = text[-END:], text.rstrip()  # patterns that are tied to the end are sought there
    if _BROKEN.search(last) and not _ENTITY_TAIL.search(last) or _ENTITY.search(last):
        return "broken", "", ""
    last = full[-END:]
    if _MARKS.search(last):
        return "marked", "", ""
    dots = _DOTS.search(last)
    if (kind == "code" and not _PROSE_END.search(text)) or (kind is None and looks_like_code(text)):
        return ("dots", "", "") if dots else _code_end(text, kind)
    body = full[: len(full) - len(last) + dots.start()] if dots else text
    fence, start = None, 0
    for match in _FENCES.finditer(body):
        if fence is None:
            if match[3] is not None:
                fence = match[2][:3]
        elif match[1] is not None and match[2][:3] == fence:
            fence, start = None, match.end(2)
    if fence:
        return "structure", "", ""
    stripped = body.rstrip()
    if not stripped:
        return "ended", "", ""
    after = stripped[start:].strip()
    if start and not after:
        return "ended", "", ""
    paragraph = stripped[max(start, stripped.rfind("\n\n"), stripped.rfind("\n\r\n")) :]
    line = paragraph[paragraph.rfind("\n") + 1 :]
    if line.count("`") % 2 or re.search(r"\[[^\]\n]*$|\]\([^)\n]*$|(?<!\w)\"[^\"\n]*$(?<!\")", line) and line.count('"') % 2 or line.count("(") > line.count(")"):
        return "structure", "", ""
    if dots:
        return "dots", "", ""
    space = body[len(stripped) :]
    stop = None
    for stop in _STOP.finditer(line):
        pass
    tail = line[stop.end() :].strip() if stop else line
    if stop and not tail:
        return "ended", "", ""
    if space and not space.strip(" \t") and not text.endswith("\n"):
        return "space", "", ""
    bare = _CALL.sub("", _LOG.sub("", _ITEM.sub("", tail))) if not stop else tail
    log = not stop and bool(_LOG.match(_ITEM.sub("", tail)))
    words = _WORD.findall(bare)
    if not words:
        return "ended", "", ""
    if not (stripped[-1].isalnum() or stripped[-1] in ",:;-–—/&+=<|("):
        return "ended", "", ""
    heading = bare.lstrip().startswith("#")
    title = kind == "title" or heading
    if stripped[-1] in ",-–—/&+=<|(" or (stripped[-1] in ":;" and not title):
        return "structure", "", ""
    caps = sum(w[:1].isupper() for w in words)
    if log or (not title and len(words) >= 3 and bare.lstrip()[:1].isupper() and caps * 2 < len(words) + 1):
        return "sentence", words[-1], words[-2] if len(words) > 1 else "^"
    if heading and "\n" in stripped:
        return "structure", "", ""
    if title or (caps == len(words) > 2):
        return "title", "", ""
    return "word", words[-1], words[-2] if len(words) > 1 else ("^" if not stop else ".")


def _baseline_words(text: str, counts: Counter, finals: Counter, follows: Counter, follow_finals: Counter) -> None:
    for line in text.split("\n"):
        found = _WORD.findall(line)
        if not found:
            continue
        counts.update(found)
        ends = line.rstrip().endswith(found[-1])
        if ends:
            finals[found[-1]] += 1
        sentence = len(found) > 2 and line.lstrip()[:1].isupper() and not _ITEM.match(line)
        if not sentence:
            follows.update(found[:-1])
            if ends and len(found) > 1:
                follow_finals[found[-2]] += 1


def _baseline_code(text: str, counts: Counter, finals: Counter) -> None:
    """How often each kind of Python line ends a block that is not the text's last."""
    lines = [x for x in text.split("\n") if x.strip()]
    for line, below in zip(lines, lines[1:], strict=False):
        head = _PY_STATEMENT.match(line.lstrip())
        key = f"py:{head[1] if head else 'other'}:{'deep' if line[:1] in ' \t' else 'top'}"
        counts[key] += 1
        if line[:1] in " \t" and below[:1] not in " \t#)]}":
            finals[key] += 1


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, finals, follows, follow_finals = (Counter() for _ in range(4))

    def flush() -> pa.RecordBatch:
        words = list(counts.keys() | follows.keys())
        columns = [[c[w] for w in words] for c in (counts, finals, follows, follow_finals)]
        for c in (counts, finals, follows, follow_finals):
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["word", "n", "final", "followed", "follow_final"])

    for batch in batches:
        for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            if kind == "code" or (kind is None and looks_like_code(text)):
                if is_python(text):
                    _baseline_code(text, counts, finals)
            else:
                _baseline_words(text, counts, finals, follows, follow_finals)
        if len(counts) > 300_000:
            yield flush()
    yield flush()


def _states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kinds = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = [examine(t, k) for t, k in zip(texts, kinds, strict=True)]
        units = [None if t is None else sum(ord(c) > 0xFFFF for c in t) + len(t) if not t.isascii() else len(t) for t in texts]
        # a broken last character was cut from longer bytes than the sign that stands for it shows
        sizes = [None if t is None else len(t) if t.isascii() else len(t.rstrip("\ufffd").encode("utf-8", "replace")) for t in texts]
        lengths = [None if t is None else len(t) for t in texts]
        arrays = [batch.column(0), batch.column(1), batch.column(3), batch.column(4)]
        arrays += [pa.array(x, pa.int64()) for x in (lengths, sizes, units)] + [pa.array(list(x), pa.string()) for x in zip(*found, strict=True)] if texts else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())] * 3
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "source", "kind", "n_chars", "chars", "bytes", "units", "state", "word", "before"])


def source_baselines(states: DataFrame) -> DataFrame:
    """(source, limit_chars, limit_bytes, rules): field limits, and how claimed lengths relate to real ones; null where there is none.

    A rule is (unit, plus): the claim is the length in that unit plus a constant.  At most 3 / CLAIM_SHARE rules fit a source."""
    full = states.where("state <> ''")

    def greatest(unit: str) -> DataFrame:
        """(source, rows, greatest length, rows that have it): counted by length first, so a large source is spread."""
        counted = full.groupBy("source", unit).agg(F.count("*").alias("n"))
        return counted.groupBy("source").agg(F.sum("n").alias("rows"), F.max(F.struct(unit, "n")).alias(unit))

    rows = greatest("chars").join(greatest("bytes").drop("rows"), "source")

    def piled(unit: str):
        return (F.col(f"{unit}.n") >= LIMIT_ROWS) & (F.col(f"{unit}.n") >= LIMIT_SHARE * F.col("rows"))

    limits = rows.select(
        "source", "rows",
        F.when(piled("chars") & (F.col("chars.n") * 2 > F.col("bytes.n")), F.col("chars.chars")).alias("limit_chars"),
        F.when(piled("bytes") & (F.col("bytes.n") >= F.col("chars.n")), F.col("bytes.bytes")).alias("limit_bytes"),
    )
    claims = full.where("n_chars IS NOT NULL").selectExpr("source", "stack(3, 'chars', n_chars - chars, 'bytes', n_chars - bytes, 'units', n_chars - units) AS (unit, plus)")
    rules = claims.groupBy("source", "unit", "plus").agg(F.count("*").alias("n")).join(limits.select("source", "rows"), "source")
    rules = rules.where((F.col("n") >= CLAIM_SHARE * F.col("rows")) & (F.col("n") > 1)).groupBy("source").agg(F.collect_set(F.struct("unit", "plus")).alias("rules"))
    return limits.join(rules, "source", "left").select("source", "limit_chars", "limit_bytes", "rules")


def terminator_baselines(states: DataFrame) -> DataFrame:
    """(source, kind, terminated): the share of texts that end with a terminator, among those whose end could have one; kind '' for null.

    A source with few texts of a kind has the share of the kind.
    """
    ends = states.where("state IN ('ended', 'sentence', 'word')").groupBy("source", "kind").agg(F.count_if(F.col("state") == "ended").alias("good"), F.count("*").alias("n"))
    ends = ends.select("source", F.coalesce("kind", F.lit("")).alias("kind"), "good", "n")
    kinds = ends.groupBy("kind").agg(F.sum("good").alias("all_good"), F.sum("n").alias("all"))
    share = F.when(F.col("n") >= TERMINATED_ROWS, F.col("good") / F.col("n")).otherwise(F.col("all_good") / F.col("all"))
    return ends.join(kinds, "kind").select("source", "kind", share.alias("terminated"))


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, source, reason): the documents cut off before their end; one row per ``doc_id``.

    A null source is a source of its own; a null ``n_chars`` claims nothing; ``kind`` may be null or missing.
    """
    kind = F.col("kind") if "kind" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text", kind.alias("kind"), F.col("n_chars").cast("long").alias("n_chars"))
    schema = "doc_id long, source string, kind string, n_chars long, chars long, bytes long, units long, state string, word string, before string"
    states = materialised(rows.mapInArrow(_states, schema).dropDuplicates(["doc_id"]), "states").where("state <> ''")
    # words are counted per worker and summed before anything is joined; only the words that stand at an end go on
    by_word = F.col("state").isin("word", "line", "sentence")
    needed = states.where(by_word).select("word").union(states.where("state IN ('word', 'sentence')").select("before")).distinct()
    words = rows.select("text", "kind").mapInArrow(_words, "word string, n long, final long, followed long, follow_final long")
    stats = words.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "final", "followed", "follow_final"))).join(needed, "word", "left_semi")
    stats = materialised(stats, "words")
    # rows whose end asks for no word are not joined with any
    known = states.where(by_word).join(stats.select("word", "n", "final"), "word", "left")
    known = known.join(stats.select(F.col("word").alias("before"), "followed", "follow_final"), "before", "left")
    missing = [F.lit(None).cast("long").alias(c) for c in ("n", "final", "followed", "follow_final")]
    all_rows = known.unionByName(states.where(~by_word).select("*", *missing)).withColumn("_kind", F.coalesce("kind", F.lit("")))
    habits = terminator_baselines(states).withColumnRenamed("kind", "_kind")
    all_rows = all_rows.join(source_baselines(states), "source", "left").join(habits, ["source", "_kind"], "left")
    measured = {"chars": F.col("chars"), "bytes": F.col("bytes"), "units": F.col("units")}

    def obeyed(rule):
        size = F.when(rule["unit"] == "chars", measured["chars"]).when(rule["unit"] == "bytes", measured["bytes"]).otherwise(measured["units"])
        return size + rule["plus"] == F.col("n_chars")

    claims_more = (F.col("n_chars") > F.col("chars")) & F.col("rules").isNotNull() & ~F.exists("rules", obeyed)
    at_limit = F.col("chars").between(F.col("limit_chars") - 1, F.col("limit_chars")) | F.col("bytes").between(F.col("limit_bytes") - 3, F.col("limit_bytes"))
    at_limit = F.coalesce(at_limit, F.lit(False))
    state = F.col("state")
    n, final, followed, follow_final = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "final", "followed", "follow_final"))
    number = F.col("word").rlike(r"^\d+$")
    # the text at hand is one of the counted uses, and no witness for itself
    may_follow = F.when(F.col("before").isin(".", "^"), False).when(followed < KNOWN_WORD, True).otherwise((follow_final > 1) & (follow_final - 1 >= FOLLOW_SHARE * followed))
    ends_lines = (n >= KNOWN_WORD) & (final > 1) & (final - 1 >= FINAL_SHARE * n)
    never_ends = (n >= COMMON_WORD) & (final - 1 < FINAL_SHARE * n)
    may_end = F.when(number, may_follow).when(ends_lines, True).when(never_ends, False).otherwise(may_follow)
    open_sentence = (state == "sentence") & (F.coalesce("terminated", F.lit(1.0)) >= TERMINATED_SHARE)
    stops = F.when(state.isin("word", "sentence"), ~may_end).when(state == "line", ~((final > 0) & (final >= FINAL_SHARE * n)))
    reason = (
        F.when(state.isin("structure", "broken", "space"), state)
        .when(open_sentence, F.lit("sentence"))
        .when(state == "marked", state)
        .when(F.coalesce(claims_more, F.lit(False)), F.lit("claim"))
        .when(at_limit & (state != "ended"), F.lit("limit"))
        .when(F.coalesce(stops, F.lit(False)), F.lit("phrase"))
    )
    return all_rows.select("doc_id", "source", reason.alias("reason")).where("reason IS NOT NULL")


def truncation_rates(docs: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate) for every source with a non-blank text."""
    cut = truncated(docs).groupBy("source").agg(F.count("*").alias("truncated"))
    full = docs.where(F.length(F.trim("text")) > 0).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.countDistinct("doc_id").alias("documents"))
    n = F.coalesce("truncated", F.lit(0))
    return full.join(cut, "source", "left").select("source", "documents", n.alias("truncated"), F.round(n / F.col("documents"), 6).alias("rate"))
