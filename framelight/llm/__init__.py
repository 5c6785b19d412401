"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
its queries only when it can be imported.
"""
