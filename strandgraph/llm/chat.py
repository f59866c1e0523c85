"""Chat formatting by schema fingerprints, in DataFrame functions only.

A layout is recognised by a fingerprint: the hash of its sorted nested field
paths.  Each known fingerprint selects a declarative mapping (an expression
over those fields) that yields canonical turns array<struct<role,text>>; there
is no guessing by names at run time.  Tables are recognised by their schema
(fields outside the known vocabulary are ignored); JSON records, which may
differ from row to row, by the fingerprint of each row's own schema.

Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and
roles a backslash is put into every ``<|`` (and one more into every ``<\\|``,
and so on), so no control string can come from a text and ``parse`` restores
each one exactly.

Null roles and texts count as empty.  Turns are ordered by turn (nulls first),
then role, then text, so ties and repeated rows have one order.  A null
conversation id is a group of its own.  Unknown JSON layouts give null turns;
an unknown table layout is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import running_sums
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
_PAIR = "array<struct<role:string,text:string>>"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', coalesce({text}, ''))"


def _each(array: str, role: str, text: str) -> str:
    return f"transform({array}, m -> named_struct('role', coalesce(m.{role}, ''), 'text', coalesce(m.{text}, '')))"


#: Layout -> (field paths, expression for the turns of a row).
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "turn rows": (("conv_id", "role", "text", "turn"), ""),
    "messages": (("messages", "messages[].content", "messages[].role"), _each("messages", "role", "content")),
    "from-value": (("conversations", "conversations[].from", "conversations[].value"), f"transform({_each('conversations', 'from', 'value')}, t -> named_struct('role', case t.role when 'human' then 'user' when 'gpt' then 'assistant' else t.role end, 'text', t.text))"),
    "prompt and response": (("prompt", "response"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
    "prompt and completion": (("completion", "prompt"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'completion')})"),
    "instruction and output": (("instruction", "output"), f"array({_turn('user', 'instruction')}, {_turn('assistant', 'output')})"),
    "instruction, input and output": (
        ("input", "instruction", "output"),
        f"array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', instruction, nullif(input, ''))), {_turn('assistant', 'output')})",
    ),
    "system, prompt and response": (("prompt", "response", "system"), f"array({_turn('system', 'system')}, {_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
}
_VOCABULARY = {path for paths, _ in LAYOUTS.values() for path in paths}


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; [] marks array elements."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            path = f"{at}.{f.name}" if at else f.name
            out += [path, *field_paths(f.dataType, path)]
        return out
    return []


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Fingerprint -> layout.
REGISTRY = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def layout_of(schema: T.StructType) -> str:
    """The layout whose fingerprint the known fields of a table have."""
    known = [p for p in field_paths(schema) if p in _VOCABULARY]
    found = REGISTRY.get(fingerprint(known))
    if found is None:
        raise ValueError(f"no layout has the fields {sorted(known)}")
    return found


def canonical_turns(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and turns of each row or, for turn rows, conv_id and turns of each conversation."""
    name = layout_of(df.schema)
    if name != "turn rows":
        return df.select(*keys, F.expr(LAYOUTS[name][1]).cast(_PAIR).alias("turns"))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


#: For JSON records: the same layouts, as field paths of a variant's schema with scalar types left out.
def _json_shape(paths: tuple[str, ...]) -> str:
    inner = {p.split("[].")[0] for p in paths if "[]." in p}
    out = []
    for p in sorted(p for p in paths if "[]" not in p):
        out.append(f"{p}: ARRAY<OBJECT<{', '.join(sorted(q.split('[].')[1] for q in paths if q.startswith(p + '[].')))}>>" if p in inner else p)
    return f"OBJECT<{', '.join(out)}>"


def canonical_turns_json(df: DataFrame, record: str) -> DataFrame:
    """df with layout and turns of a JSON text column whose rows may differ in layout."""
    if clash := {"layout", "turns"} & {*df.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    shape = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), ": [A-Z]+(?:\\([0-9,]+\\))?(?=[,>])", "")
    mark = F.sha2(shape, 256)
    layout = turns = None
    for name, (paths, mapping) in LAYOUTS.items():
        if not mapping:
            continue
        fields = [p for p in paths if "[]" not in p]
        kind = {p: f"ARRAY<STRUCT<{','.join(f'`{q.split("[].")[1]}`:STRING' for q in paths if q.startswith(p + '[].'))}>>" if any(q.startswith(p + "[].") for q in paths) else "STRING" for p in fields}
        is_it = mark == F.sha2(F.lit(_json_shape(paths)), 256)
        layout = F.when(is_it, name) if layout is None else layout.when(is_it, name)
        turns = (F.when if turns is None else turns.when)(is_it, _mapped(record, mapping, fields, kind))
    return df.withColumns({"layout": layout, "turns": turns})


def _bind(mapping: str, fields: list[str]) -> str:
    import re

    return re.sub(r"(?<![\w'.])(" + "|".join(map(re.escape, fields)) + r")(?![\w'(])", r"_r.\1", mapping)


def _mapped(record: str, mapping: str, fields: list[str], kind: dict[str, str]) -> Column:
    schema = "STRUCT<" + ",".join(f"`{p}`:{kind[p]}" for p in fields) + ">"
    return F.expr(f"transform(array(from_json(`{record}`, '{schema}')), _r -> {_bind(mapping, fields)})[0]").cast(_PAIR)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column) -> Column:
    """The formatted conversation."""
    one = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, control strings in texts restored."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")

    def one(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part))
        return F.struct(_unescape_role(F.substring(role, len(START) + 1, F.length(role))).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, one)


def loss_spans(formatted: Column, trained: str = "assistant") -> Column:
    """array<struct<start,end>>: code points of a formatted conversation that carry loss (the trained role's texts)."""

    def spans(parts: Column) -> Column:
        starts = running_sums(F.transform(parts, lambda p: F.length(p) + len(END) + 1))

        def span(p: Column, at: Column) -> Column:
            head = F.substring_index(p, "\n", 1)
            own = _unescape_role(F.substring(head, len(START) + 1, F.length(p))) == trained
            return F.when(own, F.struct((at + F.length(head) + 1).alias("start"), (at + F.length(p)).alias("end")))

        return F.filter(F.zip_with(parts, starts, span), lambda s: s.isNotNull())

    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    return F.get(F.transform(F.array(parts), spans), 0)


def format_chats(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys (conv_id for turn rows), formatted and loss_spans."""
    turns = canonical_turns(df, keys)
    return turns.select(*(c for c in turns.columns if c != "turns"), render(F.col("turns")).alias("formatted")).withColumn("loss_spans", loss_spans(F.col("formatted")))


def op8_chat_format(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    done = format_chats(rows.unionByName(extra))
    read = done.withColumn("turns", parse(F.col("formatted")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = read.withColumn("loss", F.array_join(masked, ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
