"""Reading datasets and reference tables, writing results and exports."""
