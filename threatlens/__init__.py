"""threatlens: phishing / smishing analytics on Spark DataFrames.

Every operator is a function from Column/DataFrame to Column/DataFrame;
Catalyst plans the work, Python runs only where a built-in expression
cannot express the semantics (multipart mail, a user-supplied model).
"""

__version__ = "0.1.0"
