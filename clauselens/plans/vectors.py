"""Vectors with what belongs to them, and their dimension."""

from clauselens.registry import sql_query

sql_query("vector_metadata", "SELECT e.vec_id, e.label, d.lang, d.source, b.quality FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels b ON d.doc_id = b.doc_id")
sql_query("dq_vector_dim", "SELECT size(embedding) AS dim, COUNT(*) AS n FROM embeddings GROUP BY size(embedding)", "SELECT len(embedding) AS dim, COUNT(*) AS n FROM embeddings GROUP BY len(embedding)")
