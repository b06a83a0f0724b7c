"""Features of supplied tags and dependency trees, and sentences by rules. Each is an expression over the arrays of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import constants as C
from loomtext.functions.text import entropy_of_counts, hashed, let, multiplicities

# Word classes that head clauses, and the relations in which they do.
CLAUSE_TAGS = ("VERB", "AUX")
CLAUSE_RELATIONS = ("ROOT", "advcl", "relcl", "ccomp", "xcomp", "conj")


def tag_runs(names: Column) -> Column:
    """Names of runs of three neighbours, sorted. `names` is a plain column or a lambda's, of numbers."""
    runs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(names) - 1, F.lit(2))), lambda i: F.xxhash64(F.get(names, i - 2), F.get(names, i - 1), F.get(names, i)))
    return F.sort_array(F.slice(runs, F.lit(1), F.greatest(F.size(names) - 2, F.lit(0))))


def run_entropy(runs: Column) -> Column:
    """Shannon entropy in bits of sorted runs, which are a plain column or a lambda's; null if there are none.

    Few distinct runs occur very often, so they are counted by where they begin and not folded one by one.
    """
    return F.when(F.size(runs) > 0, entropy_of_counts(F.size(runs), multiplicities(runs)))


def tag_entropy(tags: Column) -> Column:
    """Shannon entropy in bits of runs of three tags; null for fewer than three."""
    return let(let(hashed(tags), tag_runs), run_entropy)


def roots(heads: Column) -> Column:
    """The root above each token, from the index of each token's head (a root's is its own, or none).

    Each step doubles how far up the tree it looks, so a tree of depth d takes log2(d) passes over the array, and one that finds nothing new.
    """
    sound = F.transform(heads, lambda h, i: F.when((h >= 0) & (h < F.size(heads)), h).otherwise(i).cast("int"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(heads), F.lit(1)))).cast("int"))
    state = lambda above, done: F.struct(above.alias("above"), done.alias("done"))

    def step(a: Column, _: Column) -> Column:
        further = F.transform(a["above"], lambda i: F.get(a["above"], i))
        return F.when(a["done"], a).otherwise(let(further, lambda new: state(new, F.coalesce(new == a["above"], F.lit(False)))))

    return F.aggregate(steps, state(sound, F.lit(False)), step, lambda a: a["above"])


def clause_places(tags: Column, relations: Column, top: Column) -> Column:
    """The sorted roots of the sentences that each clause belongs to, with one entry per clause. The columns are plain ones or a lambda's."""
    clause = lambda i: F.coalesce(F.get(tags, i).isin(*CLAUSE_TAGS) & F.get(relations, i).isin(*CLAUSE_RELATIONS), F.lit(False))
    return F.sort_array(F.filter(top, lambda r, i: r.isNotNull() & clause(i)))


def clause_shape(top: Column, places: Column) -> Column:
    """Struct of mean and variance of the number of clauses of a sentence, from the roots of tokens and those of clauses."""

    def shape(x: Column) -> Column:
        mean = x["sum"] / x["n"]
        return F.when(x["n"] >= C.MIN_SENTENCES, F.struct(mean.alias("mean"), ((x["n"] * x["squares"] - x["sum"] * x["sum"]) / (x["n"] * x["n"])).alias("variance")))

    squares = F.aggregate(multiplicities(places), F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c)
    return let(F.struct(F.size(F.array_distinct(top)).cast("long").alias("n"), F.size(places).cast("long").alias("sum"), squares.alias("squares")), shape)


def clause_density(tags: Column, relations: Column, heads: Column) -> Column:
    """Struct of mean and variance of the number of clauses of a sentence, which is a tree; null for fewer than three sentences.

    A clause is a verb or auxiliary in one of CLAUSE_RELATIONS. Missing tags and relations count for none.
    """
    return let(roots(heads), lambda top: let(clause_places(tags, relations, top), lambda places: clause_shape(top, places)))


#: Words with a full stop that do not end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "rev", "gen", "sen", "rep", "st", "sr", "jr", "vs", "etc", "cf", "al", "fig", "figs", "eq", "eqs", "sec", "ch",
    "no", "nos", "vol", "pp", "ed", "eds", "approx", "inc", "ltd", "co", "corp", "dept", "est", "jan", "feb", "mar", "apr", "jun", "jul", "aug",
    "sep", "sept", "oct", "nov", "dec",
)
#: The patterns below mean the same to Java and RE2.
WHITE = r"\x09-\x0D\x20"
OPENERS, CLOSERS = r"[\x22\x27\(\[\{\x{2018}\x{201C}\x{00AB}]", r"[\x22\x27\)\]\}\x{2019}\x{201D}\x{00BB}]"
PIECE = f"[^{WHITE}]+[{WHITE}]*|[{WHITE}]+"
#: One full stop, or a run with an exclamation or question mark, and what closes behind it. Two full stops are an ellipsis.
ENDING = rf"(?:(?:^|[^.!?])\.|[!?]+\.?){CLOSERS}*[{WHITE}]*$"
SHORT = rf"^{OPENERS}*(?:(?i:{'|'.join(ABBREVIATIONS)})|(?:\p{{L}}\.)+\p{{L}}|\p{{Lu}})\.[{WHITE}]*$"
#: A sentence that follows the full stop of a word without a space.
JOINED = r"(\p{Ll}\.)(\p{Lu}\p{Ll})"
#: Where a sentence ends, two control characters; the first one of a text gets another one behind it.
CUT, ESCAPE, ESCAPED = "\u0001\u0002", "\u0001", "\u0001\u0003"


def sentence_pieces(text: Column) -> Column:
    """The text's sentences with the white space behind them: put together they are the text. Blank texts are one sentence, empty ones none.

    Decimals, dotted abbreviations (e.g., U.S.), those of ABBREVIATIONS, initials and ellipses do not end a sentence; closing quotes and
    brackets belong to the one they close.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED)), JOINED, f"$1{CUT}$2")
    pieces = F.regexp_extract_all(marked, F.lit(PIECE), F.lit(0))
    ends = F.transform(pieces, lambda p: F.when(p.rlike(ENDING) & ~p.rlike(SHORT), F.concat(p, F.lit(CUT))).otherwise(p))
    return F.transform(F.filter(F.split(F.array_join(ends, ""), CUT), lambda s: s != ""), lambda s: F.replace(s, F.lit(ESCAPED), F.lit(ESCAPE)))


def rule_sentences(text: Column) -> Column:
    """The same without white space around them, and without blank ones."""
    return F.filter(F.transform(sentence_pieces(text), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: s != "")
