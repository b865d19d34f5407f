"""From query text to postfix, and from postfix to DataFrames."""
