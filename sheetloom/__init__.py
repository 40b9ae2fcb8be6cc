"""sheetloom: drawing, geometry and detection data as Spark DataFrames."""
