"""Conversations: one form for all, and the forms they are turned into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import let, strip, truncate_middle
from weftline.operators.tree import merged

MESSAGES = "array<struct<role:string,content:string>>"
DEFAULT_SYSTEM = "You are a helpful assistant."


def collect(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """Turn rows to one array of messages for each conversation."""
    m = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(by).agg(F.transform(m, lambda x: F.struct(x["role"], x["content"])).alias("messages"))


def from_pairs(pairs: Column, system: Column | None = None, default_system: str | None = None) -> Column:
    """from/value pairs to messages; a system text, or the default if it is wanted, comes first. Roles stay."""
    body = F.transform(pairs, lambda p: F.struct(p["from"].alias("role"), p["value"].alias("content")))
    first = F.nullif(system, F.lit("")) if system is not None else F.lit(None).cast("string")
    first = F.coalesce(first, F.lit(default_system)) if default_system else first
    head = F.array_compact(F.array(F.when(first.isNotNull(), F.struct(F.lit("system").alias("role"), first.alias("content")))))
    return F.concat(head, body)


def to_pairs(m: Column, default_system: str = DEFAULT_SYSTEM) -> Column:
    """system and from/value pairs; a leading system message is taken out and stripped."""
    led = F.coalesce(F.get(m, F.lit(0))["role"] == "system", F.lit(False))
    rest = F.when(led, F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    pairs = F.transform(rest, lambda x: F.struct(x["role"].alias("from"), x["content"].alias("value")))
    return F.struct(F.when(led, strip(F.get(m, F.lit(0))["content"])).otherwise(F.lit(default_system)).alias("system"), pairs.alias("conversations"))


def to_text(m: Column, generate: bool = False) -> Column:
    """Marked-up text of all messages, with an opened assistant turn at the end if one is to be generated."""
    turn = lambda x: F.concat(F.lit("<|im_start|>"), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["content"], F.lit("")), F.lit("<|im_end|>\n"))
    out = F.array_join(F.transform(m, turn), "")
    return F.concat(out, F.lit("<|im_start|>assistant\n")) if generate else out


def from_text(x: Column) -> Column:
    """Messages of marked-up text."""
    parts = F.filter(F.split(x, r"<\|im_end\|>\n?"), lambda p: F.instr(p, "<|im_start|>") > 0)
    group = lambda p, k: F.regexp_extract(p, r"(?s)<\|im_start\|>([^\n]*)\n(.*)$", k)
    return F.transform(parts, lambda p: F.struct(group(p, 1).alias("role"), group(p, 2).alias("content")))


def to_simulated(m: Column) -> Column:
    """Named speakers, one after the other; other roles keep their own name."""
    name = lambda r: F.when(r == "user", "Human").when(r == "assistant", "AI").when(r == "system", "System").when(r == "function", "Function").otherwise(r)
    return F.array_join(F.transform(m, lambda x: F.concat(name(x["role"]), F.lit(": "), x["content"])), "\n\n")


def to_outline(m: Column) -> Column:
    return F.array_join(F.transform(m, lambda x: F.concat(F.initcap(x["role"]), F.lit(":\t"), x["content"])), "\n---\n")


def to_lines(m: Column) -> Column:
    return F.array_join(F.transform(m, lambda x: F.concat(F.coalesce(x["role"], F.lit("<missing>")), F.lit("\n"), F.coalesce(x["content"], F.lit("")))), "\n")


def truncated(m: Column, edge: int = 200) -> Column:
    return F.transform(m, lambda x: F.struct(x["role"], truncate_middle(x["content"], edge).alias("content")))


def last(m: Column, k: int) -> Column:
    return F.slice(m, F.greatest(F.lit(1), F.size(m) - k + 1), F.lit(k))


def one_turn(system: Column, user: Column, assistant: Column) -> Column:
    """Up to three messages; null parts are left out."""
    say = lambda r, c: F.when(c.isNotNull(), F.struct(F.lit(r).alias("role"), c.alias("content")))
    return F.array_compact(F.array(say("system", system), say("user", user), say("assistant", assistant)))


def has_markup(m: Column, marks: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<think>", "</think>", "<|endoftext|>")) -> Column:
    """Whether a message holds text of an already rendered template."""
    return F.exists(m, lambda x: F.coalesce(F.greatest(*(F.instr(x["content"], k) for k in marks)) > 0, F.lit(False)))


def chat_format(keys: Column) -> Column:
    """By the keys of a row."""
    return F.when(F.array_contains(keys, "messages"), "chatml").when(F.array_contains(keys, "conversations"), "sharegpt").otherwise("unknown")


def with_reference(m: Column, answer: Column) -> Column:
    """The teacher's messages: the reference answer is added to the last user message's text."""
    n = F.size(m)
    lead = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(-1), lambda a, k: F.when(F.get(m, k)["role"] == "user", k).otherwise(a))
    block = F.concat(F.lit("\n\n<reference_answer>\n"), answer, F.lit("\n</reference_answer>"))
    return F.transform(m, lambda x, k: F.struct(x["role"], F.when(k == lead, F.concat(x["content"], block)).otherwise(x["content"]).alias("content")))


def tools(x: Column) -> Column:
    """A list given as JSON text, as VARIANT; anything else is null."""
    v = F.try_parse_json(x)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), v)


def message_list(x: Column) -> Column:
    """Messages of a list given as JSON text, with role and content or with from and value; null where it is no list.

    A message that names nobody is an error; other keys are left out."""
    got = F.from_json(F.when(F.startswith(F.ltrim(x), F.lit("[")), x), "array<struct<role:string,content:string,from:string,value:string>>")
    nobody = F.raise_error(F.lit("message without role or from")).cast("string")
    pair = lambda m: m["from"].isNotNull() & m["value"].isNotNull()
    role = lambda m: F.when(pair(m), m["from"]).when(m["role"].isNotNull(), m["role"]).otherwise(nobody)
    content = lambda m: F.when(pair(m), m["value"]).otherwise(F.coalesce(m["content"], F.lit("")))
    return F.transform(got, lambda m: F.struct(role(m).alias("role"), content(m).alias("content")))


WHOLE = "array<struct<role:string,content:variant,extra:map<string,variant>>>"
#: Keys of a message that are its role and content; all others are extra.
SAID = ("role", "content", "from", "value")


def messages_whole(x: Column) -> Column:
    """role, content and extra of the messages of a list given as JSON text; null where it is no list.

    content stays what it is, a text, a list of parts or null, and is an empty text where it is missing. extra has all
    other keys with their values: calls of tools, names, reasoning. A message that names nobody is an error, and so is one
    that is no object."""
    wrong = lambda said: F.raise_error(F.lit(said)).cast("string")
    text = lambda v: let(F.try_variant_get(v, "$", "string"), lambda t: F.coalesce(t, F.when(v.isNull() | (F.schema_of_variant(v) == "VOID"), F.lit("None")).otherwise(F.to_json(v))))

    def one(f: Column) -> Column:
        has = lambda k: F.map_contains_key(f, k)
        pair = has("from") & has("value")
        role = F.when(f.isNull(), wrong("message is not an object")).when(pair, text(F.element_at(f, "from"))).when(has("role"), text(F.element_at(f, "role"))).otherwise(wrong("message without role or from"))
        content = F.when(pair, F.element_at(f, "value")).when(has("content"), F.element_at(f, "content")).otherwise(F.parse_json(F.lit('""')))
        return F.struct(role.alias("role"), content.alias("content"), F.map_filter(f, lambda k, _: ~k.isin(*SAID)).alias("extra"))

    listed = F.from_json(F.when(F.startswith(F.ltrim(x), F.lit("[")), x), "array<variant>")
    return F.transform(listed, lambda m: let(F.when(F.startswith(F.schema_of_variant(m), F.lit("OBJECT")), F.try_variant_get(m, "$", "map<string,variant>")), one))


def normalize_whole(row: Column) -> Column:
    """As normalize_messages with form chatml, with what messages_whole keeps of each message."""
    field = lambda k: messages_whole(F.get_json_object(row, f"$.{k}"))
    has = F.coalesce(F.array_contains(F.json_object_keys(row), "messages"), F.lit(False))
    missing = F.raise_error(F.lit("no messages in row")).cast(WHOLE)
    other = F.coalesce(field("outbound_messages"), field("input_messages"), field("conversations"), missing)
    return F.when(row.isNull(), F.lit(None).cast(WHOLE)).when(F.startswith(F.ltrim(row), F.lit("[")), messages_whole(row)).when(has, F.coalesce(field("messages"), missing)).otherwise(other)


def said(m: Column) -> Column:
    """Messages with their content as text: as it is, or as JSON where it isn't a text; a null stays null."""
    plain = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).when(F.schema_of_variant(c) != "VOID", F.to_json(c))
    return F.transform(m, lambda x: F.struct(x["role"], plain(x["content"]).alias("content")))


def normalize_messages(row: Column, form: str = "auto") -> Column:
    """Messages of a row given as JSON text, whatever its form.

    A bare list is the messages. In an object, from/value pairs under conversations count where form is sharegpt, or auto
    and there is no messages field; otherwise the first of messages, outbound_messages, input_messages and conversations
    that is a list, be it as text. A row without any is an error; null stays null."""
    has = lambda k: F.coalesce(F.array_contains(F.json_object_keys(row), k), F.lit(False))
    field = lambda k: message_list(F.get_json_object(row, f"$.{k}"))
    pairs = F.transform(field("conversations"), lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value")))
    shared = from_pairs(pairs, F.get_json_object(row, "$.system"))
    missing = F.raise_error(F.lit("no messages in row")).cast(MESSAGES)
    other = F.coalesce(field("outbound_messages"), field("input_messages"), field("conversations"), missing)
    chatml = F.when(has("messages"), F.coalesce(field("messages"), missing)).otherwise(other)
    by_form = {"chatml": chatml, "sharegpt": F.coalesce(shared, missing), "auto": F.when(has("conversations") & ~has("messages"), F.coalesce(shared, missing)).otherwise(chatml)}[form]
    return F.when(row.isNull(), F.lit(None).cast(MESSAGES)).when(F.startswith(F.ltrim(row), F.lit("[")), message_list(row)).otherwise(by_form)


def fields(m: Column) -> Column:
    """Keys and values, as text, of the JSON objects that the first user and the first assistant message hold; of keys in
    both, the assistant's. A message that is missing or holds no object is an error."""

    def held(who: str) -> Column:
        def of(x: Column) -> Column:
            got = F.from_json(F.when(F.startswith(F.ltrim(x["content"]), F.lit("{")), x["content"]), "map<string,string>")
            said = F.when(x.isNull(), F.lit(f"no {who} message found")).otherwise(F.lit(f"{who} message holds no JSON object"))
            return F.coalesce(got, F.raise_error(said).cast("map<string,string>"))

        return let(F.get(F.filter(m, lambda x: x["role"] == who), F.lit(0)), of)

    return let(F.struct(held("user").alias("user"), held("assistant").alias("assistant")), lambda x: merged(x["user"], x["assistant"]))
