"""tessera: PySpark analytics for LLM-application data (documents, retrieval, routing, evaluation, behaviour, governance)."""
