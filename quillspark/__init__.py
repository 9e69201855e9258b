"""quillspark: document-consistency analytics and corpus preparation on Spark DataFrames."""
