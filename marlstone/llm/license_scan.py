"""License scans: template markup compiled into one token automaton that reads each text once.

A template is mandatory words, optional regions (which may nest) and replaceable regions (wordings to choose from, or any a to
b words). parse() makes a tree of it, compile_templates() a nondeterministic automaton whose states wait for a word, and whose
gap states let any word pass so many times. All templates and all phrases run side by side; a place of the text is
tried as the start of each, so a text is accepted if its mandatory wording stands in it exactly, wherever it is. The live
states are at most those of the automaton, so time is linear in the words, however often a text repeats itself; a long text
is read in pieces, states carried over, so memory does not grow with its words.

Words are maximal runs of ASCII letters and digits and of anything beyond ASCII, A-Z taken as a-z. Null and empty texts
have no words, no labels and score 0. Every row is scanned for itself: repeated rows, ties and null ids need no rule. The
result has the key and the columns below only, so other columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import give_back
from .license_templates import PHRASES, TEMPLATES

PIECE = 1 << 20  # bytes of text that are words at a time
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MARK = re.compile(r'<<beginOptional>>|<<endOptional>>|<<var;name="[^"]*";original="[^"]*";match="([^"]*)">>|\n')


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


# ----------------------------------------------------------------- templates
def parse(markup: str) -> list[tuple]:
    """The tree of a template: ("word", w), ("optional", tree), ("choice", [words, ...]), ("gap", a, b), and
    ("section", n) after each line outside optional regions that has n > 0 mandatory words."""
    stack, at, mandatory = [[]], 0, 0
    for m in [*_MARK.finditer(markup), None]:
        plain = words_of(markup[at : m.start() if m else len(markup)].encode())
        stack[-1] += [("word", w) for w in plain]
        mandatory += len(plain) if len(stack) == 1 else 0
        if (m is None or m[0] == "\n") and len(stack) == 1 and mandatory:
            stack[0].append(("section", mandatory))
            mandatory = 0
        if m is None:
            break
        at = m.end()
        if m[0] == "<<beginOptional>>":
            stack.append([])
        elif m[0] == "<<endOptional>>":
            inner = stack.pop()
            if not stack:
                raise ValueError("endOptional without beginOptional")
            stack[-1] += [("optional", inner)] if inner else []
        elif m[0] != "\n":
            if span := re.fullmatch(r"\.\{(\d+),(\d+)\}", m[1]):
                stack[-1].append(("gap", int(span[1]), int(span[2])))
            else:
                stack[-1].append(("choice", [words_of(x.encode()) for x in m[1].split("|")]))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    if not any(kind == "section" for kind, *_ in stack[0]):
        raise ValueError("a template needs mandatory words")
    return stack[0]


def pattern(tree: list[tuple]) -> str:
    """The same as a regular expression over words that each end with a space."""
    out = []
    for kind, *x in tree:
        if kind == "word":
            out.append(re.escape(x[0].decode()) + " ")
        elif kind == "optional":
            out.append(f"(?:{pattern(x[0])})?")
        elif kind == "choice":
            out.append("(?:" + "|".join("".join(re.escape(w.decode()) + " " for w in c) for c in x[0]) + ")")
        elif kind == "gap":
            out.append(f"(?:[^ ]+ ){{{x[0]},{x[1]}}}")
    return "".join(out)


def sections(tree: list[tuple]) -> list[tuple[list[tuple], float]]:
    """Each beginning of a template up to a section's end, and the share of the mandatory words that it has."""
    ends = [k for k, node in enumerate(tree) if node[0] == "section"]
    total, have, out = sum(tree[k][1] for k in ends), 0, []
    for k in ends:
        have += tree[k][1]
        out.append((tree[:k], have / total))
    out[-1] = (tree, 1.0)  # what may follow the last section can be needed too
    return out


# ----------------------------------------------------------------- the automaton
@dataclass
class Automaton:
    """States wait for a word (None: any). after: what a state leads to once it has read its word.

    A target is a state, or ~k of the k-th gap or mark: a gap (most, targets) lets up to most words pass before its targets;
    a mark (template, share) says that a section's end is reached."""

    word: list[bytes | None] = field(default_factory=list)
    after: list[tuple[int, ...]] = field(default_factory=list)
    extra: list[tuple] = field(default_factory=list)
    starts: dict[bytes, list[int]] = field(default_factory=dict)

    def add(self, tree: list[tuple], template: int, share: list[float]) -> None:
        """Adds a template; built from its end, so that each node knows what follows it."""
        first = self._chain(tree, (), template, list(share))
        for s in first:
            if s < 0 or self.word[s] is None:
                raise ValueError("a template must begin with words")
            self.starts.setdefault(self.word[s], []).append(s)

    def _state(self, word: bytes | None, after: tuple[int, ...]) -> tuple[int, ...]:
        self.word.append(word)
        self.after.append(after)
        return (len(self.word) - 1,)

    def _chain(self, tree: list[tuple], then: tuple[int, ...], template: int, share: list[float]) -> tuple[int, ...]:
        for kind, *x in reversed(tree):
            if kind == "word":
                then = self._state(x[0], then)
            elif kind == "section":
                self.extra.append(("mark", template, share.pop()))
                then = (*then, ~(len(self.extra) - 1))
            elif kind == "optional":
                then = tuple(dict.fromkeys((*self._chain(x[0], then, template, share), *then)))
            elif kind == "choice":
                ways = []
                for words in x[0]:
                    way = then
                    for w in reversed(words):
                        way = self._state(w, way)
                    ways += way
                then = tuple(dict.fromkeys(ways))
            else:
                least, most = x
                if most > least:
                    self.extra.append(("gap", most - least, then))
                    then = (*then, ~(len(self.extra) - 1))
                for _ in range(least):
                    then = self._state(None, then)
        return then


def compile_templates(templates: list[tuple[str, str]], phrases: dict[str, str]) -> tuple[Automaton, list[str]]:
    """One automaton, and the label of each of its templates: those first, then the phrases."""
    machine = Automaton()
    for k, markup in enumerate([*(m for _, m in templates), *phrases]):
        tree = parse(markup)
        shares = [s for _, s in sections(tree)]
        if tree[-1][0] != "section":  # optional or replaceable words at the end: accepted only behind them
            last = max(i for i, node in enumerate(tree) if node[0] == "section")
            tree = tree[:last] + tree[last + 1 :] + [tree[last]]
        machine.add(tree, k, shares)
    return machine, [*(label for label, _ in templates), *phrases.values()]


def read(machine: Automaton, text: bytes, piece: int = PIECE):
    """(number of words, accepted, share): accepted are (template, start, end) in words, end exclusive; share is the largest
    share of mandatory words read, by template."""
    text, marks, share, base, at = text.translate(_TABLE), [], {}, 0, 0
    word, after, extra, starts = machine.word, machine.after, machine.extra, machine.starts
    live: dict[int, int] = {}  # waiting state: where its match began
    gaps: dict[int, tuple[int, int]] = {}  # open gap: words it has read up to here, and where its match began
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        for i, w in enumerate(words, base):
            new = starts.get(w)
            if not live and not gaps and new is None:
                continue
            reached = [(t, b) for s, b in live.items() if word[s] is None or word[s] == w for t in after[s]]
            reached += [(t, i) for s in new or () for t in after[s]]
            live, still = {}, gaps
            gaps = {}
            for g, (entered, b) in still.items():
                if i - entered < extra[g][1]:
                    gaps[g] = (entered, b)
                    reached += [(t, b) for t in extra[g][2]]
            for t, b in reached:
                if t >= 0:
                    live[t] = max(b, live.get(t, b))
                elif extra[~t][0] == "mark":
                    _, k, part = extra[~t]
                    share[k] = max(part, share.get(k, 0.0))
                    if part == 1:
                        marks.append((k, b, i + 1))
                else:  # entered last, it may go on longest; of these the latest beginning
                    gaps[~t] = (i + 1, max(b, gaps[~t][1]) if ~t in gaps and gaps[~t][0] == i + 1 else b)
        base += len(words)
        at = end
    return base, marks, share


def scan(df: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base (places of phrases), first_word and last_word (least and largest of these, null without),
    base_labels, labels (those of accepted templates too; sorted arrays), spans (label, start, end of accepted
    templates, in words) and score: the largest share of a template's mandatory words, by whole sections, that the text has
    in order and in place; 1 if a template is accepted."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    compile_templates(templates, phrases)  # errors of markup show here
    source = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<label: string, start: long, end: long>>, score double"
    schema = StructType([source.schema.fields[0], *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        machine, label = compile_templates(templates, phrases)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                n, marks, share = read(machine, value.as_py())
                places = [(label[t], b) for t, b, _ in marks if t >= len(templates)]
                spans = sorted({(label[t], b, e) for t, b, e in marks if t < len(templates)}, key=lambda x: (x[1], x[2], x[0]))
                base, at = sorted({x for x, _ in places}), [b for _, b in places]
                score = max((part for t, part in share.items() if t < len(templates)), default=0.0)
                rows.append((n, len(places), min(at, default=None), max(at, default=None), base, sorted({*base, *(x for x, _, _ in spans)}), [dict(zip(("label", "start", "end"), s, strict=True)) for s in spans], score))
            columns = list(zip(*rows, strict=True)) or [()] * (len(arrow) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)
        give_back()

    return source.mapInArrow(run, schema)
