"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from quirekit.llm import mixing, neighbours
from quirekit.llm.fingerprints import op6_fingerprints
from quirekit.llm.html_extraction import op1_html_extraction
from quirekit.llm.license_scan import op4_licenses
from quirekit.llm.mixing import op8_mixing
from quirekit.llm.near_duplicates import op5_near_duplicates
from quirekit.llm.neighbours import op7_nearest
from quirekit.llm.packing import op3_packing
from quirekit.llm.passages import op9_repeated_passages
from quirekit.llm.quality import op10_quality
from quirekit.llm.secret_scan import op2_secrets

QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_secrets, op3_packing, op4_licenses, op5_near_duplicates, op6_fingerprints, op7_nearest, op8_mixing, op9_repeated_passages, op10_quality)}
#: Exact neighbours and raking are for SQL; lexers, automata, learned scores, signatures, chains and packings are not: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op7_nearest": neighbours.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL}
