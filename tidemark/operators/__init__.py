"""Set-wise and ordered-scan operators over DataFrames."""
