"""Operations of a training-data pipeline on whole tables: one module an operator, queries in :mod:`sparklode.llm.queries`."""
