"""Family links one or two hops away; deeper questions go to ``hierarchy``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def clean_relations(relations: DataFrame) -> DataFrame:
    """Distinct (person_id_from, person_id_to, relation_type) without null ends and self links, the type in lower case."""
    kind = F.lower(F.trim("relation_type"))
    out = relations.select("person_id_from", "person_id_to", kind.alias("relation_type")).dropna()
    return out.filter("person_id_from <> person_id_to").distinct()


def relations_of(person_id: int, relations: DataFrame, person: DataFrame) -> DataFrame:
    """(direction, relation_type, other_id, name) of one person's links both ways."""
    r = clean_relations(relations)
    out = r.filter(F.col("person_id_from") == person_id).select(F.lit("to").alias("direction"), "relation_type", F.col("person_id_to").alias("other_id"))
    into = r.filter(F.col("person_id_to") == person_id).select(F.lit("from").alias("direction"), "relation_type", F.col("person_id_from").alias("other_id"))
    return out.unionByName(into).join(person.select(F.col("person_id").alias("other_id"), "name"), "other_id", "left")


def _parents(relations: DataFrame) -> DataFrame:
    return clean_relations(relations).filter("relation_type = 'parent'").select(F.col("person_id_from").alias("parent"), F.col("person_id_to").alias("child"))


def siblings(relations: DataFrame) -> DataFrame:
    """(person_id, sibling_id): distinct other children of a person's parents."""
    p = _parents(relations)
    q = p.select("parent", F.col("child").alias("other"))
    return p.join(q, "parent").filter("child <> other").select(F.col("child").alias("person_id"), F.col("other").alias("sibling_id")).distinct()


def grandchildren(relations: DataFrame) -> DataFrame:
    """(person_id, grandchild_id)."""
    p = _parents(relations)
    q = p.select(F.col("parent").alias("mid"), F.col("child").alias("grandchild_id"))
    return p.join(q, p.child == q.mid).select(F.col("parent").alias("person_id"), "grandchild_id").distinct()


def family_context(relations: DataFrame) -> DataFrame:
    """(person_id, role, other_id): children, parents and spouses of every person."""
    r = clean_relations(relations)
    a, b, kind = F.col("person_id_from"), F.col("person_id_to"), F.col("relation_type")
    out = r.select(F.explode(F.array(
        F.struct(a.alias("person_id"), F.when(kind == "parent", "child").when(kind == "spouse", "spouse").alias("role"), b.alias("other_id")),
        F.struct(b.alias("person_id"), F.when(kind == "parent", "parent").when(kind == "spouse", "spouse").alias("role"), a.alias("other_id")),
    )).alias("x"))
    return out.select("x.*").filter("role is not null").distinct()


def tree_persons(person: DataFrame, faces: DataFrame, relations: DataFrame) -> DataFrame:
    """(person_id, face_count, children, parents) of all persons, each counted before the join."""
    r = clean_relations(relations).filter("relation_type = 'parent'")
    count = lambda df, key, name: df.groupBy(F.col(key).alias("person_id")).agg(F.count("*").alias(name))
    out = person.select("person_id")
    for part, name in ((count(faces, "person_id", "face_count"), "face_count"), (count(r, "person_id_from", "children"), "children"), (count(r, "person_id_to", "parents"), "parents")):
        out = out.join(part, "person_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
