"""What the fixed workbook of plans.models comes to: nodes, chunks and rendered lines, for the SQL twins.

The rows were written out from the engine once and then read through against the cells; they hold results fast against change.
"""

# fmt: off
NODES = [
    ('cell:calc!a1', 'cell', 'A1', 'region:calc!a1:a22', None, None, None, None, None, None, 0),
    ('cell:feb!a1', 'cell', 'A1', 'region:feb!a1', None, None, None, None, None, None, 0),
    ('cell:inputs!b1', 'cell', 'B1', 'region:inputs!a1:b5', None, None, None, None, None, None, 0),
    ('cell:inputs!b2', 'cell', 'B2', 'region:inputs!a1:b5', None, None, None, None, None, None, 0),
    ('cell:inputs!b3', 'cell', 'B3', 'region:inputs!a1:b5', None, None, None, None, None, None, 0),
    ('cell:inputs!b4', 'cell', 'B4', 'region:inputs!a1:b5', None, None, None, None, None, None, 0),
    ('cell:inputs!b5', 'cell', 'B5', 'region:inputs!a1:b5', None, None, None, None, None, None, 0),
    ('cell:jan!a1', 'cell', 'A1', 'region:jan!a1', None, None, None, None, None, None, 0),
    ('cell:mar!a1', 'cell', 'A1', 'region:mar!a1', None, None, None, None, None, None, 0),
    ('cell:sales!a1', 'cell', 'A1', 'region:sales!a1:d5', None, 'Item', None, 'Item', None, None, 0),
    ('cell:sales!b1', 'cell', 'B1', 'region:sales!a1:d5', None, 'Qty', None, 'Qty', None, None, 0),
    ('cell:sales!c1', 'cell', 'C1', 'region:sales!a1:d5', None, 'Price', None, 'Price', None, None, 0),
    ('cell:sales!d1', 'cell', 'D1', 'region:sales!a1:d5', None, 'Total', None, 'Total', None, None, 0),
    ('chart:sales!chart1', 'chart', 'A1', 'sheet:sales', None, None, None, None, 'Sales!B2:B4 range', '', 0),
    ('column:calc!a1:a22', 'column', 'A1:A22', 'region:calc!a1:a22', None, None, None, 'Column A', None, None, 0),
    ('column:feb!a1', 'column', 'A1', 'region:feb!a1', None, None, None, 'Column A', None, None, 0),
    ('column:inputs!a1:a5', 'column', 'A1:A5', 'region:inputs!a1:b5', None, None, None, 'Column A', None, None, 0),
    ('column:inputs!b1:b5', 'column', 'B1:B5', 'region:inputs!a1:b5', None, None, None, 'Column B', None, None, 0),
    ('column:jan!a1', 'column', 'A1', 'region:jan!a1', None, None, None, 'Column A', None, None, 0),
    ('column:mar!a1', 'column', 'A1', 'region:mar!a1', None, None, None, 'Column A', None, None, 0),
    ('column:sales!a2:a5', 'column', 'A2:A5', 'region:sales!a1:d5', None, None, 'Orders', 'Item', None, None, 0),
    ('column:sales!b2:b4', 'column', 'B2:B4', 'region:sales!a1:d5', None, None, None, None, None, None, 0),
    ('column:sales!b2:b5', 'column', 'B2:B5', 'region:sales!a1:d5', None, None, 'Orders', 'Qty', None, None, 0),
    ('column:sales!c2:c5', 'column', 'C2:C5', 'region:sales!a1:d5', None, None, 'Orders', 'Price', None, None, 0),
    ('column:sales!d2:d4', 'column', 'D2:D4', 'region:sales!a1:d5', None, None, None, None, None, None, 0),
    ('column:sales!d2:d5', 'column', 'D2:D5', 'region:sales!a1:d5', None, None, 'Orders', 'Total', None, None, 0),
    ('data_validation:inputs!validation_b4', 'data_validation', 'B4', 'sheet:inputs', None, None, None, None, 'Sales!A2:A4 range', '', 0),
    ('formula:calc!a1', 'formula', 'A1', 'region:calc!a1:a22', '=Rate*100', '10', None, None, 'Inputs!B1 named_range', '', 0),
    ('formula:calc!a11', 'formula', 'A11', 'region:calc!a1:a22', '=SUM(A8#)', '24', None, None, 'Calc!A8:A10 spill', '', 0),
    ('formula:calc!a12', 'formula', 'A12', 'region:calc!a1:a22', '=YEAR(Inputs!B3)', '2024', None, None, 'Inputs!B3 cell', '', 0),
    ('formula:calc!a13', 'formula', 'A13', 'region:calc!a1:a22', '=IF(Inputs!B4,1,2)', '1', None, None, 'Inputs!B4 cell', '', 0),
    ('formula:calc!a14', 'formula', 'A14', 'region:calc!a1:a22', '=Inputs!B5+1', '#DIV/0!', None, None, 'Inputs!B5 cell', '', 0),
    ('formula:calc!a17', 'formula', 'A17', 'region:calc!a1:a22', '=LET(x,A1,x*2)', '20', None, None, 'Calc!A1 cell', '', 0),
    ('formula:calc!a18', 'formula', 'A18', 'region:calc!a1:a22', '=SUM(Sales!B:B)', '24', None, None, 'Sales!B1:B5 range', '', 0),
    ('formula:calc!a19', 'formula', 'A19', 'region:calc!a1:a22', '=SUM(Sales!2:3)', '24.5', None, None, 'Sales!A2:D3 range', '', 0),
    ('formula:calc!a2', 'formula', 'A2', 'region:calc!a1:a22', '=SUM(Sales!B2:B4)', '12', None, None, 'Sales!B2:B4 range', '', 0),
    ('formula:calc!a20', 'formula', 'A20', 'region:calc!a1:a22', '=NOSUCH(1)', '1', None, None, None, None, 0),
    ('formula:calc!a21', 'formula', 'A21', 'region:calc!a1:a22', '=SUM(Orders[Total])', '63.5', None, None, 'Sales!D2:D4 table_column', '', 0),
    ('formula:calc!a22', 'formula', 'A22', 'region:calc!a1:a22', '=Nowhere!A1', '#REF!', None, None, '', 'Nowhere!A1 malformed', 0),
    ('formula:calc!a3', 'formula', 'A3', 'region:calc!a1:a22', '=Local+1', '1.2', None, None, 'Inputs!B2 named_range', '', 0),
    ('formula:calc!a4', 'formula', 'A4', 'region:calc!a1:a22', '=INDIRECT("A1")', '10', None, None, '', 'INDIRECT indirect', 0),
    ('formula:calc!a5', 'formula', 'A5', 'region:calc!a1:a22', '=SUM(Jan:Mar!A1)', '6', None, None, 'Feb!A1 cell, Jan!A1 cell, Mar!A1 cell', '', 0),
    ('formula:calc!a6', 'formula', 'A6', 'region:calc!a1:a22', '=[Other.xlsx]S!A1', '7', None, None, '', '[Other.xlsx]S!A1 external_link', 0),
    ('formula:calc!a7', 'formula', 'A7', 'region:calc!a1:a22', '=Mac!A1', '7', None, None, '', 'Mac!A1 macro_sheet', 0),
    ('formula:calc!a8', 'formula', 'A8', 'region:calc!a1:a22', '=Sales!B2:B4*2', '6', None, None, 'Sales!B2:B4 range', '', 0),
    ('formula:sales!b5', 'formula', 'B5', 'region:sales!a1:d5', '=SUM(Orders[Qty])', '12', None, None, 'Sales!B2:B4 table_column', '', 0),
    ('formula:sales!d5', 'formula', 'D5', 'region:sales!a1:d5', '=SUM(Orders[Total])', '63.5', None, None, 'Sales!D2:D4 table_column', '', 0),
    ('named_range:inputs!b1', 'named_range', 'B1', 'region:inputs!a1:b5', None, None, None, None, None, None, 0),
    ('named_range:inputs!b2', 'named_range', 'B2', 'region:inputs!a1:b5', None, None, None, None, None, None, 0),
    ('named_range:local_sheet_calc_', 'named_range', 'B2', 'sheet:inputs', None, None, None, None, 'Inputs!B2 cell', None, 0),
    ('named_range:loose', 'named_range', '', 'workbook', None, None, None, None, None, 'SUM(Inputs!$B$1:$B$2) not a static range', 0),
    ('named_range:rate', 'named_range', 'B1', 'sheet:inputs', None, None, None, None, 'Inputs!B1 cell', None, 0),
    ('formula:calc!a15:a16', 'range', 'A15:A16', 'region:calc!a1:a22', '=A16', None, None, None, 'Calc!A15:A16 cell', '', 0),
    ('formula:sales!d2:d4', 'range', 'D2:D4', 'region:sales!a1:d5', '=Orders[[#This Row],[Qty]]*Orders[[#This Row],[Price]]', None, None, None, 'Sales!B2:C4 cell', '', 0),
    ('range:calc!a15:a16', 'range', 'A15:A16', 'region:calc!a1:a22', None, None, None, None, None, None, 0),
    ('range:calc!a8:a10', 'range', 'A8:A10', 'region:calc!a1:a22', None, None, None, None, None, None, 0),
    ('range:sales!a2:a4', 'range', 'A2:A4', 'region:sales!a1:d5', None, None, None, None, None, None, 0),
    ('range:sales!a2:d3', 'range', 'A2:D3', 'region:sales!a1:d5', None, None, None, None, None, None, 0),
    ('range:sales!b1:b5', 'range', 'B1:B5', 'region:sales!a1:d5', None, None, None, None, None, None, 0),
    ('range:sales!b2:b4', 'range', 'B2:B4', 'region:sales!a1:d5', None, None, None, None, None, None, 0),
    ('range:sales!b2:c4', 'range', 'B2:C4', 'region:sales!a1:d5', None, None, None, None, None, None, 0),
    ('sheet:calc', 'sheet', 'A1:A22', 'workbook', None, None, None, None, None, None, 1),
    ('sheet:feb', 'sheet', 'A1', 'workbook', None, None, None, None, None, None, 1),
    ('sheet:inputs', 'sheet', 'A1:B5', 'workbook', None, None, None, None, None, None, 4),
    ('sheet:jan', 'sheet', 'A1', 'workbook', None, None, None, None, None, None, 1),
    ('sheet:mac', 'sheet', '', 'workbook', None, None, None, None, None, None, 0),
    ('sheet:mar', 'sheet', 'A1', 'workbook', None, None, None, None, None, None, 1),
    ('sheet:sales', 'sheet', 'A1:D5', 'workbook', None, None, None, None, None, None, 2),
    ('region:calc!a1:a22', 'table', 'A1:A22', 'sheet:calc', None, None, None, None, None, None, 23),
    ('region:feb!a1', 'table', 'A1', 'sheet:feb', None, None, None, None, None, None, 2),
    ('region:inputs!a1:b5', 'table', 'A1:B5', 'sheet:inputs', None, None, None, None, None, None, 9),
    ('region:jan!a1', 'table', 'A1', 'sheet:jan', None, None, None, None, None, None, 2),
    ('region:mar!a1', 'table', 'A1', 'sheet:mar', None, None, None, None, None, None, 2),
    ('region:sales!a1:d5', 'table', 'A1:D5', 'sheet:sales', None, None, 'Orders', None, None, None, 18),
    ('workbook', 'workbook', None, None, None, None, None, None, None, None, 8),
]
CHUNKS = [
    ('chart', 'chart:sales!chart1', 'A1', 'chart chart1 on Sales', 'Chart chart1 sits at Sales!A1. It plots Sales!B2:B4.'),
    ('column', 'column:calc!a1:a22!0', 'A1:A22', 'Column A', 'Type: mixed'),
    ('column', 'column:feb!a1!0', 'A1', 'Column A', 'Type: number'),
    ('column', 'column:inputs!a1:b5!0', 'A1:B5', 'Column A', 'Type: text'),
    ('column', 'column:inputs!a1:b5!1', 'A1:B5', 'Column B', 'Type: mixed'),
    ('column', 'column:jan!a1!0', 'A1', 'Column A', 'Type: number'),
    ('column', 'column:mar!a1!0', 'A1', 'Column A', 'Type: number'),
    ('column', 'column:sales!a1:d5!0', 'A1:D5', 'Item', 'Type: text'),
    ('column', 'column:sales!a1:d5!1', 'A1:D5', 'Qty', 'Type: mixed'),
    ('column', 'column:sales!a1:d5!2', 'A1:D5', 'Price', 'Type: number'),
    ('column', 'column:sales!a1:d5!3', 'A1:D5', 'Total', 'Type: formula'),
    ('data_validation', 'data_validation:inputs!validation_b4', 'B4', 'data_validation validation B4 on Inputs', 'Data Validation validation B4 applies to Inputs!B4. It takes its allowed values or rule from Sales!A2:A4.'),
    ('formula_summary', 'formula_summary:calc!a1', 'A1', 'Formula in Calc A1', 'Formulas on worksheet Calc at A1 compute: =Rate*100. Reads: Inputs!B1 (named_range).'),
    ('formula_summary', 'formula_summary:calc!a11', 'A11', 'Formula in Calc A11', 'Formulas on worksheet Calc at A11 compute: =SUM(A8#). Reads: Calc!A8:A10 (spill).'),
    ('formula_summary', 'formula_summary:calc!a12', 'A12', 'Formula in Calc A12', 'Formulas on worksheet Calc at A12 compute: =YEAR(Inputs!B3). Reads: Inputs!B3 (cell).'),
    ('formula_summary', 'formula_summary:calc!a13', 'A13', 'Formula in Calc A13', 'Formulas on worksheet Calc at A13 compute: =IF(Inputs!B4,1,2). Reads: Inputs!B4 (cell).'),
    ('formula_summary', 'formula_summary:calc!a14', 'A14', 'Formula in Calc A14', 'Formulas on worksheet Calc at A14 compute: =Inputs!B5+1. Reads: Inputs!B5 (cell).'),
    ('formula_summary', 'formula_summary:calc!a15:a16', 'A15:A16', 'Formula pattern Calc A15:A16', 'Formulas on worksheet Calc at A15:A16 compute: =A16. This pattern repeats across 2 cells. Reads: Calc!A15:A16 (cell).'),
    ('formula_summary', 'formula_summary:calc!a17', 'A17', 'Formula in Calc A17', 'Formulas on worksheet Calc at A17 compute: =LET(x,A1,x*2). Reads: Calc!A1 (cell).'),
    ('formula_summary', 'formula_summary:calc!a18', 'A18', 'Formula in Calc A18', 'Formulas on worksheet Calc at A18 compute: =SUM(Sales!B:B). Reads: Sales!B1:B5 (range).'),
    ('formula_summary', 'formula_summary:calc!a19', 'A19', 'Formula in Calc A19', 'Formulas on worksheet Calc at A19 compute: =SUM(Sales!2:3). Reads: Sales!A2:D3 (range).'),
    ('formula_summary', 'formula_summary:calc!a2', 'A2', 'Formula in Calc A2', 'Formulas on worksheet Calc at A2 compute: =SUM(Sales!B2:B4). Reads: Sales!B2:B4 (range).'),
    ('formula_summary', 'formula_summary:calc!a20', 'A20', 'Formula in Calc A20', 'Formulas on worksheet Calc at A20 compute: =NOSUCH(1).'),
    ('formula_summary', 'formula_summary:calc!a21', 'A21', 'Formula in Calc A21', 'Formulas on worksheet Calc at A21 compute: =SUM(Orders[Total]). Reads: Sales!D2:D4 (table_column).'),
    ('formula_summary', 'formula_summary:calc!a22', 'A22', 'Formula in Calc A22', 'Formulas on worksheet Calc at A22 compute: =Nowhere!A1. Unresolved: Nowhere!A1 (malformed).'),
    ('formula_summary', 'formula_summary:calc!a3', 'A3', 'Formula in Calc A3', 'Formulas on worksheet Calc at A3 compute: =Local+1. Reads: Inputs!B2 (named_range).'),
    ('formula_summary', 'formula_summary:calc!a4', 'A4', 'Formula in Calc A4', 'Formulas on worksheet Calc at A4 compute: =INDIRECT("A1"). Unresolved: INDIRECT (indirect).'),
    ('formula_summary', 'formula_summary:calc!a5', 'A5', 'Formula in Calc A5', 'Formulas on worksheet Calc at A5 compute: =SUM(Jan:Mar!A1). Reads: Feb!A1 (cell), Jan!A1 (cell), Mar!A1 (cell).'),
    ('formula_summary', 'formula_summary:calc!a6', 'A6', 'Formula in Calc A6', 'Formulas on worksheet Calc at A6 compute: =[Other.xlsx]S!A1. Unresolved: [Other.xlsx]S!A1 (external_link).'),
    ('formula_summary', 'formula_summary:calc!a7', 'A7', 'Formula in Calc A7', 'Formulas on worksheet Calc at A7 compute: =Mac!A1. Unresolved: Mac!A1 (macro_sheet).'),
    ('formula_summary', 'formula_summary:calc!a8', 'A8', 'Formula in Calc A8', 'Formulas on worksheet Calc at A8 compute: =Sales!B2:B4*2. Reads: Sales!B2:B4 (range).'),
    ('formula_summary', 'formula_summary:sales!b5', 'B5', 'Formula in Sales B5', 'Formulas on worksheet Sales at B5 compute: =SUM(Orders[Qty]). Reads: Sales!B2:B4 (table_column).'),
    ('formula_summary', 'formula_summary:sales!d2:d4', 'D2:D4', 'Formula pattern Sales D2:D4', 'Formulas on worksheet Sales at D2:D4 compute: =Orders[[#This Row],[Qty]]*Orders[[#This Row],[Price]]. This pattern repeats across 3 cells. Reads: Sales!B2:C4 (cell).'),
    ('formula_summary', 'formula_summary:sales!d5', 'D5', 'Formula in Sales D5', 'Formulas on worksheet Sales at D5 compute: =SUM(Orders[Total]). Reads: Sales!D2:D4 (table_column).'),
    ('named_range', 'named_range:local_sheet_calc_', 'B2', 'Local (sheet Calc)', 'Named range Local (sheet Calc) is Inputs!B2.'),
    ('named_range', 'named_range:loose', '', 'Loose', 'Named range Loose is no static range: not a static range.'),
    ('named_range', 'named_range:rate', 'B1', 'Rate', 'Named range Rate is Inputs!B1.'),
    ('region', 'region:calc!a1:a22', 'A1:A22', 'Calc table A1:A22', 'Columns: Column A\nRows: 22'),
    ('region', 'region:feb!a1', 'A1', 'Feb table A1', 'Columns: Column A\nRows: 1'),
    ('region', 'region:inputs!a1:b5', 'A1:B5', 'Inputs table A1:B5', 'Columns: Column A, Column B\nRows: 5'),
    ('region', 'region:jan!a1', 'A1', 'Jan table A1', 'Columns: Column A\nRows: 1'),
    ('region', 'region:mar!a1', 'A1', 'Mar table A1', 'Columns: Column A\nRows: 1'),
    ('region', 'region:sales!a1:d5', 'A1:D5', 'Sales table A1:D5', 'Columns: Item, Qty, Price, Total\nRows: 4'),
    ('row_group', 'row_group:calc!a1:a22!rows0', 'A1:A22', 'Calc rows 1-22', '10\n12\n1.2\n10\n6\n7\n7\n6\n8\n10\n24\n2024\n1\n#DIV/0!\n0\n0\n20\n24\n24.5\n1\n63.5\n#REF!'),
    ('row_group', 'row_group:feb!a1!rows0', 'A1', 'Feb rows 1-1', '2'),
    ('row_group', 'row_group:inputs!a1:b5!rows0', 'A1:B5', 'Inputs rows 1-5', 'Rate | 0.1\nLocal | 0.2\nStart | 2024-05-01 00:00:00\nFlag | TRUE\nBad | #DIV/0!'),
    ('row_group', 'row_group:jan!a1!rows0', 'A1', 'Jan rows 1-1', '1'),
    ('row_group', 'row_group:mar!a1!rows0', 'A1', 'Mar rows 1-1', '3'),
    ('row_group', 'row_group:sales!a1:d5!rows0', 'A1:D5', 'Sales rows 1-5', 'Item | Qty | Price | Total\nBolt | 3 | 2.5 | 7.5\nNut | 4 | 1.5 | 6\nGear | 5 | 10 | 50\nSum | 12 | 63.5'),
    ('sheet', 'sheet:calc', 'A1:A22', 'Calc', 'Used range A1:A22; cells: 22'),
    ('sheet', 'sheet:feb', 'A1', 'Feb', 'Used range A1; cells: 1'),
    ('sheet', 'sheet:inputs', 'A1:B5', 'Inputs', 'Used range A1:B5; cells: 10'),
    ('sheet', 'sheet:jan', 'A1', 'Jan', 'Used range A1; cells: 1'),
    ('sheet', 'sheet:mac', '', 'Macro sheet Mac', 'Sheet Mac is a macro sheet; its cells are not loaded or run, and references to it are gaps (macro_sheet).'),
    ('sheet', 'sheet:mar', 'A1', 'Mar', 'Used range A1; cells: 1'),
    ('sheet', 'sheet:sales', 'A1:D5', 'Sales', 'Used range A1:D5; cells: 19'),
]
LINES = [
    ('schemas', False, 1, '7 sheet(s), 6 table(s), 25 formula cell(s), 3 named range(s).'),
    ('schemas', False, 2, 'Formula cells (ƒ) show the value that was saved; nothing is recalculated.'),
    ('schemas', False, 3, 'Contains macros; they were not loaded or run.'),
    ('schemas', False, 4, 'Note: sheet Mac is no worksheet'),
    ('schemas', False, 5, 'Named ranges: Local (sheet Calc) = Inputs!B2; Loose (not a static range: not a static range); Rate = Inputs!B1'),
    ('schemas', False, 6, 'This rendering is partial (detail: schemas); omissions are marked.'),
    ('schemas', False, 7, ''),
    ('schemas', False, 8, '## Sheet "Sales" - used range A1:D5'),
    ('schemas', False, 9, '### Table - Sales!A1:D5, header row(s) 1'),
    ('schemas', False, 10, 'Columns: A Item (text); B Qty (mixed); C Price (number); D Total (formula)'),
    ('schemas', False, 11, '(Rows omitted: A1:D5.)'),
    ('schemas', False, 12, 'Formulas:'),
    ('schemas', False, 13, '- B5: =SUM(Orders[Qty]) → 12; reads Sales!B2:B4'),
    ('schemas', False, 14, '- D2:D4 (3 cells, one pattern): =Orders[[#This Row],[Qty]]*Orders[[#This Row],[Price]] → values in the grid; reads Sales!B2:B4, Sales!C2:C4'),
    ('schemas', False, 15, '- D5: =SUM(Orders[Total]) → 63.5; reads Sales!D2:D4'),
    ('schemas', False, 16, 'Charts, pivot tables and validations:'),
    ('schemas', False, 17, '- chart chart1: plots Sales!B2:B4'),
    ('schemas', False, 18, ''),
    ('schemas', False, 19, '## Sheet "Inputs" - used range A1:B5'),
    ('schemas', False, 20, '### Table - Inputs!A1:B5'),
    ('schemas', False, 21, 'Columns: A Column A (text); B Column B (mixed)'),
    ('schemas', False, 22, '(Rows omitted: A1:B5.)'),
    ('schemas', False, 23, 'Charts, pivot tables and validations:'),
    ('schemas', False, 24, '- data validation validation B4 at B4: values from Sales!A2:A4'),
    ('schemas', False, 25, ''),
    ('schemas', False, 26, '## Sheet "Calc" - used range A1:A22'),
    ('schemas', False, 27, '### Table - Calc!A1:A22'),
    ('schemas', False, 28, 'Columns: A Column A (mixed)'),
    ('schemas', False, 29, '(Rows omitted: A1:A22.)'),
    ('schemas', False, 30, 'Formulas:'),
    ('schemas', False, 31, '- A1: =Rate*100 → 10; reads Inputs!B1'),
    ('schemas', False, 32, '- A11: =SUM(A8#) → 24; reads Calc!A8:A10'),
    ('schemas', False, 33, '- A12: =YEAR(Inputs!B3) → 2024; reads Inputs!B3'),
    ('schemas', False, 34, '(16 more omitted.)'),
    ('schemas', False, 35, ''),
    ('schemas', False, 36, '## Sheet "Jan" - used range A1'),
    ('schemas', False, 37, '### Table - Jan!A1'),
    ('schemas', False, 38, 'Columns: A Column A (number)'),
    ('schemas', False, 39, '(Rows omitted: A1.)'),
    ('schemas', False, 40, ''),
    ('schemas', False, 41, '## Sheet "Feb" - used range A1'),
    ('schemas', False, 42, '### Table - Feb!A1'),
    ('schemas', False, 43, 'Columns: A Column A (number)'),
    ('schemas', False, 44, '(Rows omitted: A1.)'),
    ('schemas', False, 45, ''),
    ('schemas', False, 46, '## Sheet "Mar" - used range A1, hidden'),
    ('schemas', False, 47, '### Table - Mar!A1'),
    ('schemas', False, 48, 'Columns: A Column A (number)'),
    ('schemas', False, 49, '(Rows omitted: A1.)'),
    ('schemas', False, 50, ''),
    ('schemas', False, 51, '## Sheet "Mac" - macro sheet, not loaded'),
    ('schemas', False, 52, ''),
]
# fmt: on
