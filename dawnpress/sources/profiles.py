"""Reader profiles: lookup over several collections and the context that seeds a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.functions import profiles as P
from dawnpress.operators.frames import first_per_key


def profile_lookup(
    requests: DataFrame, profiles: DataFrame, uid: str = "uid", key: str = "doc_key", field: str = "uid_field"
) -> DataFrame:
    """First profile of each requested uid.

    ``profiles`` has (collection, doc_key, uid_field, document). Lower collection numbers win; inside one collection a
    match of the document key beats a match of the uid field. Unknown and anonymous uids get a null document.
    """
    wanted = requests.select(uid).where(~F.col(uid).isin("", "anon")).distinct()
    by_key = profiles.select(F.col(key).alias(uid), "collection", F.lit(0).alias("_how"), key, "document")
    by_field = profiles.select(F.col(field).alias(uid), "collection", F.lit(1).alias("_how"), key, "document")
    found = by_key.unionByName(by_field).join(wanted, uid, "left_semi")
    first = first_per_key(found, [uid], ["collection", "_how", key])
    return requests.join(first.select(uid, "collection", "document"), uid, "left")


def seed_context(sessions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Interests and commute per session: what the request brings first, then the stored profile."""
    stored = profiles.select(F.col("uid").alias("session_id"), F.try_parse_json("document").alias("_doc"))
    joined = sessions.join(stored, "session_id", "left")
    return joined.select(
        "session_id",
        P.merged_interests(F.col("warm_interests"), P.profile_interests(F.col("_doc"))).alias("interests"),
        P.merged_commute(F.col("warm_commute"), P.profile_commute(F.col("_doc"))).alias("commute"),
    )
