"""Front matter of definition files: extraction, inference of a schema, validation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import lines

# The default schema - its id, the types of its fields, what must be there and what should be.
DEFAULT_SCHEMA = {
    "id": "okf/v0.1", "required": ["type"],
    "properties": {"type": {"type": "string", "minLength": 1}, "title": {"type": "string"}, "description": {"type": "string"}, "resource": {"type": "string", "format": "uri"}, "tags": {"type": "array", "items": {"type": "string"}}, "timestamp": {"type": "string", "format": "date-time"}},
    "recommended": ["title", "description", "resource", "tags", "timestamp"],
}
FORMATS = {"uri": r"[A-Za-z][A-Za-z0-9+.-]*:\S+", "date-time": r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:?\d\d)"}
ENTRY = "file_id string, present boolean, end_line int, error string, entries array<struct<key:string,type:string,value:string>>"


def front_matter(files: DataFrame, text: str = "text") -> DataFrame:
    """The files' columns with `present`, `end_line` (of the closing line; 0 without), `error` and `body`, the lines between the first two `---`.

    A block that doesn't end isn't present and has an error; texts that are null or begin otherwise have neither.
    """
    cut = F.transform(F.split(text, "\r?\n"), F.trim)
    close = F.array_position(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(1))), "---").cast("int")
    opens = F.coalesce(F.element_at(cut, 1) == "---", F.lit(False))
    body = F.array_join(F.slice(F.split(text, "\r?\n"), 2, F.greatest(close - 1, F.lit(0))), "\n")
    present = opens & (close > 0)
    return files.select(
        "*", present.alias("present"), F.when(present, close + 1).otherwise(0).alias("end_line"),
        F.when(opens & ~present, "unterminated front matter").alias("error"), F.when(present, body).alias("body"),
    )


def _uncommented(text: str) -> str:
    m = re.search(r"(?<=\s)#", text)
    return text[: m.start()].rstrip() if m else text


def _scalar(text: str) -> object:
    """A value in the flow style of YAML: quoted or plain text, number, boolean, null, list or map."""
    text = text.strip()
    if not text or text in ("~", "null", "Null", "NULL"):
        return None
    if text[0] in "[{" and text[-1] in "]}":
        inner, depth, quote, parts, now = text[1:-1], 0, "", [], ""
        for c in inner:
            quote = "" if quote == c else quote or (c if c in "\"'" else "")
            depth += (c in "[{") - (c in "]}") if not quote else 0
            if c == "," and not depth and not quote:
                parts.append(now)
                now = ""
            else:
                now += c
        parts = [p for p in [*parts, now] if p.strip()]
        return [_scalar(p) for p in parts] if text[0] == "[" else {k.strip().strip("\"'"): _scalar(v) for k, _, v in (p.partition(":") for p in parts)}
    if text[0] == '"' and text[-1] == '"' and len(text) > 1:
        return json.loads(text)
    if text[0] == "'" and text[-1] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[0] in "[{\"'@`%":
        raise ValueError(f"can't read {text!r}")
    text = _uncommented(text)
    if text in ("true", "True", "false", "False"):
        return text[0] in "tT"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return text


KEY = re.compile(r"""("(?:[^"\\]|\\.)*"(?=\s*:)|'(?:[^']|'')*'(?=\s*:)|[^\s:#&*!|>%@`"'\[{-](?:[^:#]|:(?=\S)|(?<=\S)#)*|-(?=\S)(?:[^:#]|:(?=\S)|(?<=\S)#)*)(?:(?<=["'])\s*)?:(?:\s+(.*))?$""")
BLOCK = re.compile(r"([|>])([+-]?)(\d?)([+-]?)\s*(?:#.*)?$")
#: How deep blocks may be nested.
DEEPEST = 60


class _Blocks:
    """Reads lines by their indents: maps, lists, block texts, anchors and what refers to them; flow values may run over several lines."""

    def __init__(self, body: str) -> None:
        self.lines, self.at, self.known = body.split("\n"), 0, {}

    def next(self) -> tuple[int, str] | None:
        """Indent and text of the next line that says something."""
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith("#")):
            self.at += 1
        if self.at == len(self.lines):
            return None
        line = self.lines[self.at].rstrip()
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise self.error("a tab as indent")
        return len(line) - len(line.lstrip()), line.lstrip()

    def error(self, what: str) -> ValueError:
        return ValueError(f"line {self.at + 2}: {what}")

    def node(self, least: int, deep: int = 0) -> object:
        """The value that begins on the next line, if that is indented by `least`."""
        found = self.next()
        if deep > DEEPEST:
            raise self.error("nested too deep")
        if found is None or found[0] < least:
            return None
        indent, text = found
        if text == "-" or text.startswith("- "):
            out = []
            while (found := self.next()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
                rest = found[1][1:].lstrip()
                inner = indent + len(found[1]) - len(rest) if rest else indent + 1
                if rest and (KEY.match(rest) or rest.startswith("- ")):  # a map or list that begins on the same line
                    self.lines[self.at] = " " * inner + rest
                    out.append(self.node(inner, deep + 1))
                else:
                    out.append(self.value(rest, indent, deep))
        elif KEY.match(text):
            out = {}
            while (found := self.next()) and found[0] == indent:
                if not (m := KEY.match(found[1])):
                    raise self.error("not a key and a value")
                key = str(_scalar(m[1])) if m[1][0] in "\"'" else m[1].strip()
                if key in out:
                    raise self.error(f"{key} is there twice")
                out[key] = self.value(m[2] or "", indent, deep)
        else:
            return self.value(text, indent, deep)
        if (found := self.next()) and found[0] > indent:
            raise self.error("not a key and a value")
        return out

    def value(self, rest: str, indent: int, deep: int) -> object:
        """What follows a key or a dash, on its line or on those below; the line is passed."""
        rest, name = rest.strip(), None
        if m := re.match(r"&([^\s,\[\]{}]+)(?:\s+|$)", rest):
            name, rest = m[1], rest[m.end() :]
        if m := re.match(r"\*([^\s,\[\]{}]+)\s*(?:#.*)?$", rest):
            if m[1] not in self.known:
                raise self.error(f"{m[1]} isn't known")
            self.at += 1
            return self.known[m[1]]
        if m := BLOCK.match(rest):
            out = self.block(m, indent)
        elif not rest or rest.startswith("#"):
            self.at += 1
            found = self.next()
            beside = found and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")) and not self.listed(indent)
            out = self.node(indent if beside else indent + 1, deep + 1)
        else:
            while rest[0] in "[{" and _open(rest) and self.at + 1 < len(self.lines):
                self.at += 1
                rest += " " + self.lines[self.at].strip()
            try:
                out = _scalar(rest)
            except ValueError as e:
                raise self.error(str(e)) from e
            self.at += 1
            if isinstance(out, str) and rest[0] not in "\"'":  # plain text may go on below
                while (found := self.next()) and found[0] > indent and not KEY.match(found[1]):
                    out += " " + _uncommented(found[1])
                    self.at += 1
        if name:
            self.known[name] = out
        return out

    def listed(self, indent: int) -> bool:
        """Whether the line just passed was an item of a list at this indent."""
        before = self.lines[self.at - 1]
        return before.lstrip().startswith("-") and len(before) - len(before.lstrip()) == indent

    def block(self, m: re.Match, indent: int) -> str:
        self.at += 1
        held: list[str] = []
        depth = indent + int(m[3]) if m[3] else None
        while self.at < len(self.lines):
            line = self.lines[self.at].rstrip("\r")
            own = len(line) - len(line.lstrip(" "))
            if line.strip():
                depth = own if depth is None else depth
                if own < depth or own <= indent:
                    break
            held.append(line[depth:] if depth is not None else "")
            self.at += 1
        end = len(held)
        while end and not held[end - 1].strip():
            end -= 1
        kept, tail, chomp = held[:end], len(held) - end, m[2] or m[4]
        if m[1] == "|":
            out = "\n".join(kept)
        else:  # single breaks fold into blanks; more deeply indented lines stay
            out = ""
            for k, line in enumerate(kept):
                if not k:
                    out = line
                elif not line:
                    out += "\n"
                elif line[0] == " " or kept[k - 1][:1] == " ":
                    out += "\n" + line
                else:
                    out += ("" if out.endswith("\n") else " ") + line
        return out if chomp == "-" or not kept else out + "\n" + ("\n" * tail if chomp == "+" else "")


def _open(text: str) -> bool:
    """Whether a flow value's brackets aren't closed yet."""
    depth, quote = 0, ""
    for c in text:
        quote = "" if quote == c else quote or (c if c in "\"'" else "")
        depth += (c in "[{") - (c in "]}") if not quote else 0
    return depth > 0


def parse_block(body: str) -> dict:
    """A map of YAML: nested maps and lists by indents, flow values, block texts (| and >, with their endings), anchors and aliases. Tags, merge keys and several documents aren't read;
    what can't be read is an error that names its line, the first after the opening one being line 2."""
    reader = _Blocks(body)
    out = reader.node(0)
    if out is not None and not isinstance(out, dict) or reader.next() is not None:
        raise reader.error("not a key and a value")
    return out or {}


def type_of(value: object) -> str:
    """The type's name in JSON Schema."""
    kinds = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}
    return "integer" if isinstance(value, float) and value.is_integer() else kinds[type(value)]


def entries(files: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, present, end_line, error, entries) of front_matter(): each key with its type and its value as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("key", pa.string()), ("type", pa.string()), ("value", pa.string())]))
        for batch in batches:
            found, errors = [], []
            for body, error in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True):
                try:
                    held = parse_block(body) if body is not None else {}
                    found.append([{"key": k, "type": type_of(v), "value": json.dumps(v, ensure_ascii=False)} for k, v in held.items()])
                except ValueError as e:
                    found.append([])
                    error = str(e)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(errors, pa.string()), pa.array(found, kind)], names=["file_id", "present", "end_line", "error", "entries"])

    at = front_matter(files, text).select(F.col("file_id").cast("string"), "present", "end_line", "error", "body")
    return at.mapInArrow(run, ENTRY)


def infer_schema(samples: DataFrame, order: str = "file_id") -> DataFrame:
    """(key, type, required, n) over entries(): the union of keys; the type is null where samples differ, required says that every sample has the key.

    Only samples with a block count. Sorted by key; counts are combined before the shuffle.
    """
    kept = samples.where("present AND error IS NULL")
    total = kept.agg(F.count("*").alias("total"))
    each = kept.select(order, F.explode("entries").alias("e")).groupBy("e.key").agg(F.count("*").alias("n"), F.min("e.type").alias("lo"), F.max("e.type").alias("hi"))
    return each.crossJoin(F.broadcast(total)).select("key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("type"), (F.col("n") == F.col("total")).alias("required"), "n").orderBy("key")


def _violations(value: object, kind: str, spec: dict, where: str) -> Iterator[tuple[str, str]]:
    """(keyword, where) of each part of a schema that a value breaks."""
    wanted = spec.get("type")
    if wanted and kind != wanted and not (wanted == "number" and kind == "integer"):
        yield "type", where
        return
    if isinstance(value, str) and len(value) < spec.get("minLength", 0):
        yield "minLength", where
    if isinstance(value, str) and spec.get("format") in FORMATS and not re.fullmatch(FORMATS[spec["format"]], value):
        yield "format", where
    if "enum" in spec and value not in spec["enum"]:
        yield "enum", where
    if isinstance(value, list) and "items" in spec:
        for i, item in enumerate(value):
            yield from _violations(item, type_of(item), spec["items"], f"{where}/{i}")


def definition_findings(samples: DataFrame, schemas: tuple[dict, ...] = (DEFAULT_SCHEMA,), must_exist: bool = False) -> DataFrame:
    """(file_id, rule_id, severity, line_from, line_to) of entries(): every breach of every schema is an error `id/keyword:where`, a missing recommended field a
    warning; a block that can't be read, or with `must_exist` one that is missing, is one error."""
    schema = "array<struct<rule_id:string,severity:string>>"

    @F.pandas_udf(schema)
    def told(found):
        out = []
        for pairs in found:
            held, rules = {p["key"]: (p["type"], p["value"]) for p in pairs}, []
            for spec in schemas:
                rules += [(f"{spec['id']}/required:{k}", "error") for k in spec.get("required", ()) if k not in held]
                for k, part in spec.get("properties", {}).items():
                    if k in held:
                        rules += [(f"{spec['id']}/{word}:{where}", "error") for word, where in _violations(json.loads(held[k][1]), held[k][0], part, k)]
                rules += [(f"{spec['id']}/recommended:{k}", "warning") for k in spec.get("recommended", ()) if k not in held]
            out.append([{"rule_id": r, "severity": s} for r, s in rules])
        import pandas as pd

        return pd.Series(out)

    one = lambda rule: F.array(F.struct(F.lit(rule).alias("rule_id"), F.lit("error").alias("severity")))
    missing = one("definitions/missing-frontmatter") if must_exist else F.array().cast(schema)
    rules = F.when(~F.col("present"), missing).when(F.col("error").isNotNull(), one("definitions/invalid-yaml")).otherwise(told(F.col("entries")))
    return samples.select("file_id", F.explode(rules).alias("r"), F.lit(1).alias("line_from"), F.greatest("end_line", F.lit(1)).alias("line_to")).select("file_id", "r.rule_id", "r.severity", "line_from", "line_to")


# Endings of Markdown files, and of files of prose.
MARKDOWN, PROSE = ["md", "mdx", "markdown"], ["md", "mdx", "markdown", "rst", "adoc", "txt"]


def is_markdown_path(path: Column) -> Column:
    return path.rlike(rf"(?i)\.({'|'.join(MARKDOWN)})$")


def is_prose_path(path: Column) -> Column:
    return path.rlike(rf"(?i)\.({'|'.join(PROSE)})$")


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: F.trim(x) != ""))
