"""Training-data operators.  Nothing outside this subpackage imports it.

``ashlar.llm.registry`` lists the queries; the operators live one to a module.
"""
