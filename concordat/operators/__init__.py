"""Set-wise operators over DataFrames."""
