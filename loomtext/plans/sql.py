"""Pieces of DuckDB SQL that the queries' SQL versions share."""

WORDS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: regexp_full_match(w, '\p{{L}}+'))"
SPACED = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"
SENTENCES = r"list_filter(list_transform(regexp_split_to_array({t}, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def words(t: str = "coalesce(text, '')") -> str:
    return WORDS.format(t=t)


def spaced(t: str = "coalesce(text, '')") -> str:
    return SPACED.format(t=t)


def sentences(t: str = "coalesce(text, '')") -> str:
    return SENTENCES.format(t=t)


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
