"""Text functions as column expressions; lengths are code points, white space is what Python's str.strip takes off in ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\t\n\x0B\f\r ]+"


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{_WS}|{_WS}$", "")


def truncate_middle(x: Column, edge: int = 200) -> Column:
    """Both edges and how many characters lie between, for texts longer than both edges."""
    n = F.char_length(x)
    cut = F.concat(F.substring(x, 1, edge), F.lit("\n... [truncated "), (n - 2 * edge).cast("string"), F.lit(" chars] ...\n"), F.right(x, F.lit(edge)))
    return F.when(n > 2 * edge, cut).otherwise(x)


def truncate_head_tail(x: Column, most: int, ratio: float = 0.3, mark: str = "\n...\n") -> Column:
    """Head of int(most * ratio) characters and the tail that fills up to most; no tail if nothing is left for it."""
    head = int(most * ratio)
    tail = most - head
    kept = F.concat(F.substring(x, 1, head), F.lit(mark), F.right(x, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.char_length(x) > most, kept).otherwise(x)


def title(x: Column, most: int = 30) -> Column:
    """White space collapsed; longer titles end in an ellipsis within most characters."""
    t = F.trim(F.regexp_replace(x, _WS, " "))
    return F.when(F.char_length(t) > most, F.concat(F.left(t, F.lit(most - 3)), F.lit("..."))).otherwise(t)


def think_split(x: Column) -> Column:
    """reasoning and answer: what the first think mark encloses, and what follows it; what precedes it is dropped.

    A mark that is still open has no answer yet. Without a mark everything is the answer; null stays null."""

    def parts(t: Column) -> Column:
        end, start = F.instr(t["body"], "</think>"), t["start"]
        reasoning = F.when(end > 0, F.substring(t["body"], F.lit(1), end - 1)).otherwise(t["body"])
        answer = F.when(end > 0, strip(F.substring(t["body"], end + 8, F.char_length(t["body"])))).otherwise(F.lit(""))
        return F.struct(F.when(start > 0, F.nullif(strip(reasoning), F.lit(""))).alias("reasoning"), F.when(start > 0, answer).otherwise(x).alias("answer"))

    start = F.instr(x, "<think>")
    return let(F.struct(start.alias("start"), F.substring(x, start + 7, F.char_length(x)).alias("body")), parts)


def assistant_split(x: Column, start: str = "<|im_start|>assistant\n", end: str = "<|im_end|>") -> Column:
    """reasoning, content, think_done of an assistant's text that may begin with the turn's start mark and a think block.

    The turn's end mark is taken off the content. Without a think block there is no reasoning (empty); one that is still
    open has no content."""

    def of(t: Column) -> Column:
        opened, close = F.startswith(t, F.lit("<think>")), F.instr(t, "</think>")
        told = strip(F.substring(t, F.lit(8), F.when(close > 0, close - 8).otherwise(F.char_length(t))))
        said = strip(F.when(~opened, t).when(close > 0, F.substring(t, close + 8, F.char_length(t))).otherwise(F.lit("")))
        content = let(said, lambda c: F.when(F.endswith(c, F.lit(end)), F.regexp_replace(F.left(c, F.char_length(c) - len(end)), rf"{_WS}$", "")).otherwise(c))
        return F.struct(F.when(opened, told).otherwise(F.lit("")).alias("reasoning"), content.alias("content"), (~opened | (close > 0)).alias("think_done"))

    led = F.when(F.startswith(x, F.lit(start)), F.substring(x, F.lit(len(start) + 1), F.char_length(x))).otherwise(x)
    return let(F.regexp_replace(led, rf"^{_WS}", ""), of)


def assistant_prefix(reasoning: Column, content: Column, done: Column) -> Column:
    """The text whose split is (reasoning, content, done)."""
    r, c = strip(F.coalesce(reasoning, F.lit(""))), strip(F.coalesce(content, F.lit("")))
    return F.when(done, F.concat(F.lit("<think>\n"), r, F.lit("\n</think>\n\n"), c)).otherwise(F.concat(F.lit("<think>\n"), r))


def wrap_assistant(x: Column, start: str = "<|im_start|>assistant\n") -> Column:
    return F.when(F.startswith(x, F.lit(start)), x).otherwise(F.concat(F.lit(start), x))


def unwrap_assistant(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^<\|im_start\|>assistant\n", ""), r"<\|im_end\|>\s*$", "")


def skipped(x: Column, most: int, ratio: float = 0.3) -> Column:
    """Head and tail of most characters together, and how many lie between; shorter texts stay."""
    head = int(most * ratio)
    mark = F.concat(F.lit("\n...[SKIP "), (F.char_length(x) - most).cast("string"), F.lit(" chars]...\n"))
    return F.when(F.char_length(x) > most, F.concat(F.left(x, F.lit(head)), mark, F.right(x, F.lit(most - head)))).otherwise(x)


def reasoning_block(x: Column, most: int | None = None) -> Column:
    """Reasoning between think marks, first cut to most characters if that is given."""
    return F.concat(F.lit("<think>\n"), x if most is None else skipped(x, most), F.lit("\n</think>"))


def assistant_parts(content: Column, reasoning: Column, most: int | None = None) -> Column:
    """reasoning, as a block of think marks or null, and answer of an assistant's message.

    Reasoning that is given counts, be it empty, and the content then stays as it is; otherwise what the content encloses in
    think marks. Null content is empty."""
    text = F.coalesce(content, F.lit(""))

    def parts(found: Column) -> Column:
        inside = reasoning.isNull() & found["reasoning"].isNotNull()
        said = F.nullif(F.when(inside, found["reasoning"]).otherwise(reasoning), F.lit(""))
        return F.struct(reasoning_block(said, most).alias("reasoning"), F.when(inside, found["answer"]).otherwise(text).alias("answer"))

    return let(think_split(text), parts)


def content_done(content: Column, stop_reason: Column) -> Column:
    """Whether there is content and generation has stopped by itself."""
    return F.coalesce((content != "") & (stop_reason == "stop"), F.lit(False))


def continued(state: Column, x: Column, start: str = "<|im_start|>assistant", end: str = "<|im_end|>") -> Column:
    """A state (prefix, generated, stop, stop_reason) with text added to the assistant's part: the wrapper's start and end
    are taken off the text, the rest stays as it is, and what has stopped the state is forgotten. An empty or null text
    leaves it."""
    led = F.when(F.startswith(x, F.lit(start)), F.substring(x, F.lit(len(start) + 1), F.char_length(x))).otherwise(x)
    body = F.when(F.endswith(led, F.lit(end)), F.left(led, F.char_length(led) - len(end))).otherwise(led)
    none = F.lit(None).cast("string")
    new = F.struct(F.concat(state["prefix"], body).alias("prefix"), F.concat(state["generated"], body).alias("generated"), none.alias("stop"), none.alias("stop_reason"))
    return F.when(F.coalesce(x, F.lit("")) == "", state).otherwise(new)


def stop_list(stops: Column) -> Column:
    """An array of stop texts; none at all, or an empty or null one, is an error."""
    good = (F.size(stops) > 0) & F.forall(stops, lambda s: F.coalesce(s != "", F.lit(False)))
    return F.when(F.coalesce(good, F.lit(False)), stops).otherwise(F.raise_error(F.lit("stop must contain non-empty strings")))


def with_stop(generated: Column, stop_reason: Column, stops: Column, include: bool = True, end: str = "<|im_end|>") -> Column:
    """text and matched: the stop text where generation has stopped at the only one there is, and the text with it added
    where it is wanted and the text doesn't hold it; the turn's end mark is never added. Of several it can't be known which
    one it was."""
    matched = F.when((stop_reason == "stop") & (F.size(stops) == 1), F.get(stops, F.lit(0)))
    missing = matched.isNotNull() & (matched != end) & ~F.contains(generated, matched)
    added = F.when(missing, F.concat(generated, matched)).otherwise(generated)
    return F.struct((added if include else generated).alias("text"), matched.alias("matched"))


def escape_display(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>"), ("\t", "&nbsp;" * 4), ("  ", "&nbsp;" * 2)):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def content_or_empty(x: Column) -> Column:
    return F.coalesce(F.nullif(strip(x), F.lit("")), F.lit("<empty>"))


def snake_case(x: Column) -> Column:
    """Every capital but a first one gets an underscore before it, and all are lower-cased; nothing else changes."""
    return F.lower(F.regexp_replace(x, r"(?<!^)(\p{Lu})", "_$1"))


def pascal_case(x: Column) -> Column:
    """Parts between underscores and hyphens, each word of letters with a capital first and small letters after it."""
    title = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")
    return F.array_join(F.transform(F.split(x, "[_-]+"), title), "")


def key_title(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def human_bytes(n: Column) -> Column:
    """With one decimal and the largest unit that keeps the number at one or more."""
    out = F.format_string("%.1f B", n.cast("double"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**k), 1))).otherwise(out)
    return out


def minified(x: Column) -> Column:
    return F.translate(x, " \n\t\r", "")


def display_width(x: Column) -> Column:
    """Columns of a terminal: wide characters of East Asia count two, combining marks none."""
    wide = F.char_length(F.regexp_replace(x, r"[^ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦\x{1F300}-\x{1F64F}\x{20000}-\x{3FFFD}]", ""))
    return F.char_length(F.regexp_replace(x, r"\p{Mn}", "")) + wide


def role(x: Column) -> Column:
    """assistant, system or user by the first letter; others as they are."""
    return F.when(F.startswith(x, F.lit("a")), "assistant").when(F.startswith(x, F.lit("s")), "system").when(F.startswith(x, F.lit("u")), "user").otherwise(x)
