"""Network-flow intrusion analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
inside one except tables whose size is checked first.
"""
