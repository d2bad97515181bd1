"""People and skills under several names: clusters of aliases, groups of skills, columns by loose names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTERS = "key long, cluster int, names array<string>"


def clusters(names: list[str]) -> list[list[str]]:
    """Names in the order of their mentions: one joins the people that had its full name, or else the only ones of its
    surname; any other begins anew. White space and case don't count."""
    out: list[dict] = []
    for name in names:
        plain = " ".join(name.split()).lower()
        last = plain.rpartition(" ")[2]
        home = next((c for c in out if plain in c["plain"]), None)
        if home is None and last:
            same = [c for c in out if c["last"] == last]
            home = same[0] if len(same) == 1 else None
        if home is None:
            home = {"plain": set(), "last": last, "names": []}
            out.append(home)
        home["plain"].add(plain)
        if name not in home["names"]:
            home["names"].append(name)
    return [c["names"] for c in out]


def clustered(mentions: DataFrame) -> DataFrame:
    """key, cluster from 1, names: people of each text. mentions(key, place, name); the fold needs a text's mentions in
    order, and they are few beside the text."""

    def run(rows):  # noqa: ANN001, ANN202
        import pandas as pd

        found = clusters(list(rows.sort_values("place")["name"]))
        return pd.DataFrame({"key": rows["key"].iloc[0], "cluster": range(1, len(found) + 1), "names": found})

    return mentions.filter(F.col("name").isNotNull()).groupBy("key").applyInPandas(run, CLUSTERS)


def skill_groups(hints: list[tuple[str, list[str]]], skills: dict[str, str]) -> list[dict]:
    """Hinted groups of known skills that no earlier group has, then every other skill alone; a group is a must if one of
    its skills is. skills: name to importance."""
    free, out = dict(skills), []
    for name, members in [*hints, *((s, [s]) for s in skills)]:
        own = [m for m in members if m in free]
        for m in own:
            del free[m]
        if own:
            out.append({"name": name, "members": own, "importance": "must" if any(skills[m] == "must" for m in own) else "nice"})
    return out


def loosely(record: Column, field: str) -> Column:
    """Of a map of texts, the entries whose key holds the name or is held by it; case and _ don't count."""
    plain = lambda x: F.replace(F.lower(x), F.lit("_"), F.lit(" "))
    wanted = field.lower().replace("_", " ")
    return F.map_filter(record, lambda k, _: F.contains(plain(k), F.lit(wanted)) | F.contains(F.lit(wanted), plain(k)))
