"""srcatlas.llm"""
