"""Queries of the library's own operators by inventory key, and the SQL that checks them."""

from spanloom.queries.documents import ORACLE as _DOCUMENT_SQL
from spanloom.queries.documents import QUERIES as _DOCUMENTS
from spanloom.queries.dupes import ORACLE as _DUPES_SQL
from spanloom.queries.dupes import QUERIES as _DUPES
from spanloom.queries.fixtures import ORACLE as _CASES_SQL
from spanloom.queries.fixtures import QUERIES as _CASES
from spanloom.queries.store import ORACLE as _STORE_SQL
from spanloom.queries.store import QUERIES as _STORE
from spanloom.queries.texts import ORACLE as _TEXT_SQL
from spanloom.queries.texts import QUERIES as _TEXTS

QUERIES = {**_DUPES, **_DOCUMENTS, **_TEXTS, **_STORE, **_CASES}
ORACLE = {**_DUPES_SQL, **_DOCUMENT_SQL, **_TEXT_SQL, **_STORE_SQL, **_CASES_SQL}
