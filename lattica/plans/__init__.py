"""Plans: materialised tables and workbook evaluation."""
