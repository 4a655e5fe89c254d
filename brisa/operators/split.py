"""Splitting free-form addresses: tokens, features, linear-chain tags, fields.

No trained model comes with this package: ``train`` fits one on labelled rows, ``Model`` takes weights.
"""

from __future__ import annotations

import re
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.functions.normalize import fold_ascii
from brisa.functions.standardize import FIELDS, format_address
from brisa.rules import builtin

#: Digits, words, or a single sign.
PIECES = (r"\d+", r"\w+", r"[^\w\s]")
TOKEN = "(?U)" + "|".join(PIECES)
MARKS = frozenset(",.;:/?!@#$%&_()-+[]{}\"'\\|")
NEIGHBOURS = (-2, -1, 1, 2)
TAGS = {"LOG": "logradouro", "NUM": "numero", "COM": "complemento", "LOC": "localidade"}
SPLIT = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
_TOKEN = re.compile("|".join(PIECES))
#: Latin letters up to U+024F and what goes with them: there ``_LATIN_TOKEN`` finds what ``TOKEN`` finds on the JVM.
_LATIN = r"^[\x00-\u024F]*\z"
_LATIN_WORD = "0-9A-Z_a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_LATIN_TOKEN = re.compile(f"[0-9]+|[{_LATIN_WORD}]+|[^{_LATIN_WORD}\t-\r \x85\xa0]")
#: How many addresses a worker keeps.
_KEPT = 50_000


def tokenize(col: Column) -> Column:
    """Runs of digits, words and single signs of the raw text."""
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))


def pieces(text: str) -> list[str]:
    """``tokenize`` of one string."""
    return _TOKEN.findall(text)


def is_mark(token: str) -> bool:
    return token[:1] in MARKS and token != ""


def _plain(token: str) -> bool:
    return all(c.isascii() and c.isalnum() for c in token)


def _size(n: int) -> str:
    return "7+" if n >= 7 else str(n)


_KINDS_OF: dict[str, list[str]] = {}


def _kinds(token: str) -> list[str]:
    norm = fold_ascii(token).strip()
    size = f"tam:{_size(len(norm))}"
    if not norm:
        return [norm, size, "is_unknown"]
    if is_mark(norm):
        return [size, "is_punct", norm[0]]
    if norm.isascii() and norm.isdigit():
        return [size, "is_digit", f"digit_len:{_size(len(norm.lstrip('0')))}"]
    if _plain(norm):
        return [norm, size, "is_alpha"] + ["has_digit"] * any(c.isdigit() for c in norm)
    return [norm, size, "is_unknown"]


def token_features(token: str, prefix: str) -> list[str]:
    """What is said of one token: itself, its size, its kind. Results are kept, as words repeat."""
    found = _KINDS_OF.get(token)
    if found is None:
        if len(_KINDS_OF) > 100_000:
            _KINDS_OF.clear()
        found = _KINDS_OF[token] = _kinds(token)
    return [f"{prefix}:{f}" for f in found]


def _walk(tokens: Sequence[str], neighbours: Sequence[int], said: Callable[[str], list], seen: Callable[[str, str], list]) -> Iterator[list]:
    """For every token what ``said`` makes of its own features and ``seen`` of the tokens around, in order."""
    n = len(tokens)
    plain = [k for k, t in enumerate(tokens) if _plain(t)]
    marks = [0]  # how many marks there are before each place
    for t in tokens:
        marks.append(marks[-1] + is_mark(t))
    upto = 0  # plain words before the token
    for i in range(n):
        while upto < len(plain) and plain[upto] < i:
            upto += 1
        after = upto + (upto < len(plain) and plain[upto] == i)
        found = [*said("bias"), *said(f"{int(i / n * 4)}_pos"), *seen(tokens[i], "0")]
        if i == 0:
            found += said("BOS")
        if i == n - 1:
            found += said("EOS")
        for d in neighbours:
            k = abs(d)
            here = after + d - 1 if d > 0 else upto - k
            if not 0 <= here < len(plain):
                continue
            at = plain[here]
            last = i if k == 1 else plain[here - 1 if d > 0 else here + 1]
            mark = f"{'+' if d > 0 else '-'}{k}"
            found += seen(tokens[at], mark)
            if at != i + d and marks[max(at, last) + 1] > marks[min(at, last)]:
                found += said(f"tem_pontuacao:{mark}")
        yield found


def features(tokens: Sequence[str], neighbours: Sequence[int] = NEIGHBOURS) -> list[list[str]]:
    """Every token's features. Neighbours are the next plain words, wherever they are."""
    if 0 in neighbours:
        raise ValueError("a neighbour is not the token itself")
    return list(_walk(tokens, neighbours, lambda f: [f], token_features))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def features_of(tokens: pd.Series) -> pd.Series:
    """``features`` of a token array column."""
    return pd.Series([None if t is None else features(list(t)) for t in tokens], dtype=object)


def assemble(tokens: Sequence[str], tags: Sequence[str]) -> dict[str, str | None]:
    """Fields from tagged tokens. The first ``B`` of a field wins; ``I`` goes on with the field that was
    begun last, whatever its own suffix; ``O`` ends it."""
    parts: dict[str, list[str]] = {}
    now: str | None = None
    for token, tag in zip(tokens, tags):
        kind, _, name = tag.partition("-")
        if kind == "B":
            now = name
            parts.setdefault(name, [token])
        elif kind == "I" and now is not None:
            parts.setdefault(now, []).append(token)
        elif kind == "O":
            now = None
    return {f: " ".join(parts[t]) if t in parts else None for t, f in TAGS.items()}


def assemble_all(tokens: Sequence[str], tags: Sequence[str]) -> dict[str, list[str]]:
    """All stretches of every label, for inspection."""
    out: dict[str, list[str]] = {k: [] for k in ("LOG", "NUM", "COM", "LOC", "MUN", "CEP")}
    now = None
    for token, tag in zip(tokens, tags):
        kind, _, name = tag.partition("-")
        if kind == "B" and name in out:
            now = name
            out[name].append(token)
        elif kind == "I" and now:
            out[now][-1] += " " + token
        else:
            now = None
    return out


@F.pandas_udf(SPLIT)
def assemble_fields(tokens: pd.Series, tags: pd.Series) -> pd.DataFrame:
    """``assemble`` of token and tag array columns."""
    rows = [dict.fromkeys(FIELDS) if t is None or g is None else assemble(list(t), list(g)) for t, g in zip(tokens, tags)]
    return pd.DataFrame(rows, columns=list(FIELDS), dtype=object)


@dataclass
class Model:
    """Weights of a linear chain: of features for tags, of tags after tags."""

    tags: list[str]
    states: dict[str, dict[str, float]] = field(default_factory=dict)
    moves: dict[tuple[str, str], float] = field(default_factory=dict)

    def _scores(self, feats: list[str]) -> dict[str, float]:
        out = dict.fromkeys(self.tags, 0.0)
        for f in feats:
            for t, w in self.states.get(f, {}).items():
                out[t] += w
        return out

    def tag(self, feats: list[list[str]]) -> list[str]:
        """The best sequence (Viterbi). Ties go to the tag listed first."""
        if not feats:
            return []
        best = [self._scores(feats[0])]
        back: list[dict[str, str]] = []
        for found in feats[1:]:
            here, come = self._scores(found), {}
            for t in self.tags:
                p = max(self.tags, key=lambda s: best[-1][s] + self.moves.get((s, t), 0.0))
                come[t] = p
                here[t] += best[-1][p] + self.moves.get((p, t), 0.0)
            best.append(here), back.append(come)
        out = [max(self.tags, key=lambda t: best[-1][t])]
        for come in reversed(back):
            out.append(come[out[-1]])
        return out[::-1]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The weights as a table: ``kind`` is tag (in order), state or move."""
        rows = [("tag", "", t, float(k)) for k, t in enumerate(self.tags)]
        rows += [("state", f, t, float(w)) for f, ts in self.states.items() for t, w in ts.items()]
        rows += [("move", a, b, float(w)) for (a, b), w in self.moves.items()]
        return spark.createDataFrame(rows, "kind string, source string, tag string, weight double")

    @classmethod
    def from_df(cls, table: DataFrame) -> "Model":
        """A model from such a table; a model is small, so it is read on the driver."""
        out = cls([])
        for r in sorted(table.select("kind", "source", "tag", "weight").collect(), key=lambda r: (r.kind != "tag", r.weight)):
            if r.kind == "tag":
                out.tags.append(r.tag)
            elif r.kind == "state":
                out.states.setdefault(r.source, {})[r.tag] = r.weight
            else:
                out.moves[r.source, r.tag] = r.weight
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Model":
        return cls.from_df(spark.read.parquet(path))

    def to_rows(self) -> list[tuple[str, str, float]]:
        """(feature or previous tag, tag, weight), largest first: for inspection."""
        rows = [(f, t, w) for f, ts in self.states.items() for t, w in ts.items()] + [(f"after:{a}", b, w) for (a, b), w in self.moves.items()]
        return sorted(rows, key=lambda r: (-r[2], r))


def train(rows: Sequence[tuple[Sequence[str], Sequence[str]]], rounds: int = 5) -> Model:
    """A model from (tokens, tags) rows: an averaged structured perceptron, on the driver.

    Meant for a bounded, labelled sample; tagging is what runs distributed.
    """
    tags = sorted({t for _, ts in rows for t in ts})
    w: dict = defaultdict(float)
    total: dict = defaultdict(float)
    since: dict = defaultdict(int)
    step = 0

    def bump(key, by: float) -> None:
        total[key] += (step - since[key]) * w[key]
        since[key] = step
        w[key] += by

    prepared = [(features(list(tok)), list(ts)) for tok, ts in rows]
    model = Model(tags)
    for _ in range(rounds):
        for feats, gold in prepared:
            guess = model.tag(feats)
            step += 1
            if guess == gold:
                continue
            for seq, by in ((gold, 1.0), (guess, -1.0)):
                for k, (found, t) in enumerate(zip(feats, seq)):
                    for f in found:
                        bump(("s", f, t), by)
                        model.states.setdefault(f, {})[t] = w["s", f, t]
                    if k:
                        bump(("m", seq[k - 1], t), by)
                        model.moves[seq[k - 1], t] = w["m", seq[k - 1], t]
    out = Model(tags)
    for key, value in w.items():
        mean = (total[key] + (step - since[key]) * value) / max(1, step)
        if mean:
            if key[0] == "s":
                out.states.setdefault(key[1], {})[key[2]] = mean
            else:
                out.moves[key[1], key[2]] = mean
    return out


class _Tagger:
    """``model.tag(features(tokens))`` of a finished model without spelling features out: the same sums in the
    same order, so ties fall alike."""

    def __init__(self, model: Model):
        self.tags = model.tags
        at = {t: k for k, t in enumerate(model.tags)}
        self.states = {f: [(at[t], w) for t, w in ts.items()] for f, ts in model.states.items()}
        self.moves = [[model.moves.get((s, t), 0.0) for s in model.tags] for t in model.tags]
        self.words: dict[tuple[str, str], list[tuple[int, float]]] = {}

    def _said(self, feature: str) -> list[tuple[int, float]]:
        return self.states.get(feature, [])

    def _seen(self, token: str, prefix: str) -> list[tuple[int, float]]:
        found = self.words.get((token, prefix))
        if found is None:
            if len(self.words) > 100_000:
                self.words.clear()
            found = self.words[token, prefix] = [x for f in token_features(token, prefix) for x in self.states.get(f, ())]
        return found

    def __call__(self, tokens: Sequence[str]) -> list[str]:
        best: list[float] = []
        back: list[list[int]] = []
        for found in _walk(tokens, NEIGHBOURS, self._said, self._seen):
            here = [0.0] * len(self.tags)
            for k, w in found:
                here[k] += w
            if best:
                come = []
                for t, moves in enumerate(self.moves):
                    ways = [b + m for b, m in zip(best, moves)]
                    most = max(ways)
                    come.append(ways.index(most))
                    here[t] += most
                back.append(come)
            best = here
        if not best:
            return []
        out = [best.index(max(best))]
        for come in reversed(back):
            out.append(come[out[-1]])
        return [self.tags[k] for k in reversed(out)]


#: Of the models used last in this worker, by key: the tagger, and what came of texts or tokens. Addresses repeat,
#: and a worker lives longer than a task.
_MODELS: dict[str, tuple[_Tagger, dict]] = {}


def _kept(key: str, model: Model) -> tuple[_Tagger, dict]:
    if key not in _MODELS:
        if len(_MODELS) >= 4:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[key] = _Tagger(model), {}
    tag, seen = _MODELS[key]
    if len(seen) > _KEPT:
        seen.clear()
    return tag, seen


def _tagger(model: Model):
    key = uuid.uuid4().hex

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(tokens: pd.Series) -> pd.Series:
        tag, seen = _kept(key, model)
        out = []
        for t in tokens:
            one = None if t is None else tuple(t)
            if one is not None and one not in seen:
                seen[one] = tag(one)
            out.append(seen.get(one))
        return pd.Series(out, dtype=object)

    return run


def tag_tokens(tokens: Column, model: Model) -> Column:
    return _tagger(model)(tokens)


#: The rule set of each field: what ``standardize_address`` applies.
_RULES = {"logradouro": "street", "numero": "number", "complemento": "complement", "localidade": "neighbourhood"}


def _splitter(model: Model, standard: bool):
    key = uuid.uuid4().hex

    @F.arrow_udf(SPLIT)
    def run(texts: pa.Array, tokens: pa.Array) -> pa.Array:
        tag, seen = _kept(key, model)
        rules = [builtin(_RULES[f]).apply for f in FIELDS]
        coded = texts.dictionary_encode()
        # Each distinct text once; where Python's pieces may differ from the JVM's, those of one of its rows.
        odd = tokens.is_valid()
        spelled = dict(zip(texts.filter(odd).to_pylist(), tokens.filter(odd).to_pylist())) if odd.true_count else {}
        found = []
        for t in coded.dictionary.to_pylist():
            parts = seen.get(t)
            if parts is None:
                words = [w for w in spelled[t].split(" ") if w] if t in spelled else _LATIN_TOKEN.findall(t)
                parts = assemble(words, tag(words)).values()
                if standard:
                    parts = [None if p is None else apply(p) for apply, p in zip(rules, parts)]
                parts = seen[t] = tuple(parts)
            found.append(parts)
        columns = zip(*found) if found else [()] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, pa.string()).take(coded.indices) for c in columns], list(FIELDS))

    # As one string, since tokens have no blanks: Arrow arrays cost many times as much on their way, even nulls.
    return lambda col: run(col, F.when(~col.rlike(_LATIN), F.array_join(tokenize(col), " ")))


def split_address(col: Column, model: Model) -> Column:
    """An address struct from a free-form text."""
    return F.when(col.isNotNull(), _splitter(model, False)(col))


def split_standardized(col: Column, model: Model) -> Column:
    """``standardize_address`` of ``split_address``, in one function: each distinct text is worked on once."""
    return _splitter(model, True)(col)


def standardize_raw_address(col: Column, model: Model) -> Column:
    """Split, standardize each field, and write it in one line."""
    return format_address(split_standardized(col, model))


def kinds_with(model: Model):
    """Further kinds of standardizers, which need a model: by name, as ``standardize.by_kind``."""
    shown = lambda a: F.to_json(a, {"ignoreNullFields": "false"})
    return {
        "completo": lambda c: standardize_raw_address(c, model),
        "separar": lambda c: shown(split_address(c, model)),
        "separar_padronizar": lambda c: shown(split_standardized(c, model)),
    }


def timing(df: DataFrame, source: str, model: Model, rows: int = 100_000) -> DataFrame:
    """Mean microseconds for an address's features and for its tags, over the first rows."""

    @F.pandas_udf(T.StructType([T.StructField("features_us", T.LongType()), T.StructField("tags_us", T.LongType())]))
    def run(tokens: pd.Series) -> pd.DataFrame:
        out = []
        for t in tokens:
            a = time.perf_counter_ns()
            found = features(list(t))
            b = time.perf_counter_ns()
            model.tag(found)
            out.append(((b - a) // 1000, (time.perf_counter_ns() - b) // 1000))
        return pd.DataFrame(out, columns=["features_us", "tags_us"])

    timed = df.limit(rows).where(F.col(f"`{source}`").isNotNull()).select(run(tokenize(F.col(f"`{source}`"))).alias("t"))
    return timed.agg(F.avg("t.features_us").alias("features_us"), F.avg("t.tags_us").alias("tags_us"))


def tune(rows: Sequence[tuple[Sequence[str], Sequence[str]]], rounds: Sequence[int] = (1, 3, 5, 10), share: float = 0.9) -> list[tuple[int, float]]:
    """(rounds, share of right tokens) on the held-out end of the rows, best first."""
    cut = int(len(rows) * share)
    out = []
    for n in rounds:
        model = train(rows[:cut], n)
        pairs = [(a, b) for tok, ts in rows[cut:] for a, b in zip(model.tag(features(list(tok))), ts)]
        out.append((n, sum(a == b for a, b in pairs) / max(1, len(pairs))))
    return sorted(out, key=lambda x: (-x[1], x[0]))


# labelled rows
LABELS = dict(zip(("logradouro", "numero", "complemento", "bairro", "municipio", "cep"), "LOG NUM COM LOC MUN CEP".split()))
FORMATS = (
    "logradouro numero complemento",
    "logradouro numero complemento bairro",
    "logradouro numero complemento bairro municipio",
    "logradouro numero complemento bairro municipio cep",
    "logradouro numero complemento cep bairro municipio",
    "logradouro numero complemento bairro cep municipio",
    "municipio bairro logradouro numero complemento",
    "logradouro bairro numero complemento municipio",
    "logradouro numero bairro complemento",
)
MISSING = ("", "S/N", "SN", "S N", "SEM NUMERO", "SEM NUM")
PREFIXES = ("N.", "NUM", "NO", "Nº")
#: How common terms are shortened on envelopes, the usual form first.
ABBREVIATIONS: dict[str, tuple[str, ...]] = {
    "ALAMEDA": ("AL", "AL."), "APARTAMENTO": ("AP", "APTO", "APT"), "AVENIDA": ("AV", "AV.", "AVE"), "BAIRRO": ("B", "BRO"),
    "BECO": ("BC", "BCO"), "BLOCO": ("BL", "BL."), "CAPITAO": ("CAP", "CAP."), "CASA": ("CS", "C"), "CHACARA": ("CH", "CHAC"),
    "CONDOMINIO": ("COND", "CD"), "CONJUNTO": ("CJ", "CONJ"), "CORONEL": ("CEL", "CEL."), "DONA": ("D", "DA"), "DOUTOR": ("DR", "DR."),
    "DOUTORA": ("DRA", "DRA."), "EDIFICIO": ("ED", "EDIF"), "ENGENHEIRO": ("ENG", "ENG."), "ESTRADA": ("EST", "ESTR"), "FAZENDA": ("FAZ", "FZ"),
    "GENERAL": ("GEN", "GAL"), "GOVERNADOR": ("GOV", "GOV."), "INDUSTRIAL": ("IND",), "JARDIM": ("JD", "JD.", "JAR"), "LADEIRA": ("LAD", "LD"),
    "LARGO": ("LG", "LGO"), "LOTE": ("LT", "LTE"), "LOTEAMENTO": ("LOT", "LOTEAM"), "MAJOR": ("MAJ", "MJ"), "MARECHAL": ("MAL", "MAR"),
    "NOSSA SENHORA": ("N SRA", "NSA SRA", "N. SRA."), "PADRE": ("PE", "PE."), "PARQUE": ("PQ", "PRQ"), "PRACA": ("PCA", "PC", "PRC"),
    "PREFEITO": ("PREF", "PREF."), "PRESIDENTE": ("PRES", "PRES."), "PROFESSOR": ("PROF", "PROF."), "PROFESSORA": ("PROFA", "PROFA."),
    "QUADRA": ("QD", "Q"), "RESIDENCIAL": ("RES", "RESID"), "RODOVIA": ("ROD", "ROD.", "RDV"), "RUA": ("R", "R.", "RU"), "SALA": ("SL", "SL."),
    "SANTA": ("STA", "STA."), "SANTO": ("STO", "STO."), "SARGENTO": ("SGTO", "SGT"), "SENADOR": ("SEN", "SEN."), "SETOR": ("ST", "SET"),
    "SITIO": ("SIT", "ST"), "TENENTE": ("TEN", "TEN."), "TRAVESSA": ("TV", "TRAV", "TR"), "VEREADOR": ("VER", "VER."), "VILA": ("VL", "VL.", "V"),
}


def label(address: dict[str, str], layout: str = FORMATS[2], separator: str = ", ") -> tuple[list[str], ...]:
    """Tokens and BIO tags of an address record in a layout."""
    tokens: list[str] = []
    tags: list[str] = []
    between = _TOKEN.findall(separator)
    for name in layout.split(" "):
        mark, found = LABELS.get(name), _TOKEN.findall((address.get(name) or "").upper())
        if not mark or not found:
            continue
        if tokens:
            tokens += between
            tags += ["O"] * len(between)
        tokens += found
        tags += [f"B-{mark}"] + [f"I-{mark}"] * (len(found) - 1)
    return tokens, tags


@F.pandas_udf(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType()))]))
def label_address(record: pd.DataFrame) -> pd.DataFrame:
    """``label`` of a struct column that may hold ``formato`` and ``separador``."""
    rows = [label(r, r.get("formato") or FORMATS[2], ", " if r.get("separador") is None else r["separador"]) for r in record.to_dict("records")]
    return pd.DataFrame(rows, columns=["tokens", "tags"])


def abbreviate(col: Column, table: dict[str, Sequence[str]]) -> Column:
    """Each term's first abbreviation in its place, as whole words."""
    for term, short in table.items():
        col = F.regexp_replace(col, rf"(?iU)\b{re.escape(term)}\b", short[0].replace("$", r"\$"))
    return col


def drop_second_word(col: Column) -> Column:
    """Without the second word, if there are more than two."""
    parts = F.split(col, " ")
    return F.when(F.size(parts) > 2, F.array_join(F.filter(parts, lambda x, i: i != 1), " ")).otherwise(col)


def add_noise(df: DataFrame, key: str, abbreviations: dict[str, Sequence[str]] = ABBREVIATIONS, seed: int = 0, clean: bool = False) -> DataFrame:
    """Address records as people write them. What happens to a row depends on its key and the seed.

    ``clean`` leaves only layouts and notations to chance.
    """

    def chance(k: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(key)), F.lit(1 << 20)) / float(1 << 20)

    def choice(k: int, values: Sequence[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(chance(k) * len(values)) + 1).cast("int"))

    out = df
    texts = "logradouro bairro municipio complemento".split()
    for k, name in enumerate(texts):
        c = F.upper(name)
        if not clean:
            c = F.when(chance(10 + k) < 0.2, abbreviate(c, abbreviations)).otherwise(c)
            c = F.when(chance(20 + k) < 0.1, drop_second_word(c)).otherwise(c)
        out = out.withColumn(name, c)
    out = out.withColumn("municipio", F.when(chance(30) < 0.1, F.concat_ws("-", "municipio", F.upper("uf"))).otherwise(F.col("municipio")))
    plain = F.col("numero").rlike(r"^[0-9]+\z")
    dotted = F.format_number(F.col("numero").try_cast("bigint"), 0)
    shown = F.when(chance(31) < (0 if clean else 0.05), dotted).otherwise(F.col("numero"))
    # The prefix is the rule here and its absence the exception, as in the corpus this follows.
    shown = F.when(chance(32) < 0.05, shown).otherwise(F.concat_ws(" ", choice(33, PREFIXES), shown))
    number = F.when(F.coalesce("numero", F.lit("")) == "", choice(34, MISSING)).when(plain, shown).otherwise(F.upper("numero"))
    code = F.lpad(F.coalesce("cep", F.lit("")), 8, "0")
    dash, both = "99999-999", "99.999-999"
    form = choice(35, (dash, both, ""))
    cut = lambda a, n: F.substring(code, a, n)
    code = F.when(form == both, F.concat(cut(1, 2), F.lit("."), cut(3, 3), F.lit("-"), cut(6, 3))).when(form == dash, F.concat(cut(1, 5), F.lit("-"), cut(6, 3))).otherwise(code)
    return out.withColumns({"numero": number, "cep": code, "formato": choice(36, FORMATS), "separador": choice(37, (", ", " "))})


# evaluation
def token_pairs(df: DataFrame, gold: str = "tags", guess: str = "predicted") -> DataFrame:
    """A row for each token: ``token, gold, guess``."""
    z = F.arrays_zip(F.col("tokens").alias("token"), F.col(gold).alias("gold"), F.col(guess).alias("guess"))
    return df.select(F.inline(z))


def label_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support for each label."""
    g = pairs.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("gold") == F.col("guess")).alias("hits"))
    p = pairs.groupBy(F.col("guess").alias("label")).agg(F.count("*").alias("claimed"))
    j = g.join(p, "label", "full").fillna(0, ["support", "hits", "claimed"])
    precision, recall = F.try_divide("hits", "claimed"), F.try_divide("hits", "support")
    return j.select("label", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"), "support")


def sequence_accuracy(df: DataFrame, gold: str = "tags", guess: str = "predicted") -> DataFrame:
    """Share of rows that are right throughout, and the mean share of right tokens a row."""
    same = F.zip_with(gold, guess, lambda a, b: (a == b).cast("int"))
    right = F.aggregate(same, F.lit(0), lambda s, x: s + x)
    return df.agg(F.avg((F.col(gold) == F.col(guess)).cast("double")).alias("sequence_accuracy"), F.avg(F.try_divide(right, F.size(gold))).alias("mean_token_accuracy"))


def error_samples(df: DataFrame, n: int = 10, seed: int = 0, gold: str = "tags", guess: str = "predicted") -> DataFrame:
    """Some rows that are wrong somewhere."""
    return df.where(F.col(gold) != F.col(guess)).orderBy(F.rand(seed)).limit(n)


def top_errors(pairs: DataFrame, by: Sequence[str] = ("token",), n: int = 20) -> DataFrame:
    """What is got wrong most often."""
    return pairs.where(F.col("gold") != F.col("guess")).groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(n)
