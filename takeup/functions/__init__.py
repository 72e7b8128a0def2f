"""SQL expression builders.

Each function takes SQL text (a column name or any expression) and returns SQL
text, to be used with ``selectExpr`` or ``F.expr``. Feature families generate
hundreds of expressions; as text each is parsed once in the JVM, while building
them from Python column objects costs milliseconds per call. Everything stays
inside the JVM.
"""
