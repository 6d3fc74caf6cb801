"""All queries of the library outside the corpus subpackage."""

from __future__ import annotations

from pinfold.queries import counts, names, places, reviews, stored

QUERIES = {**names.QUERIES, **places.QUERIES, **reviews.QUERIES, **stored.QUERIES, **counts.QUERIES}
SQL = {**names.SQL, **places.SQL, **reviews.SQL, **stored.SQL, **counts.SQL}
