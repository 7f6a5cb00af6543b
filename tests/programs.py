"""Our own sample programs."""

EXTRACT = """* monthly extract
FILE STAFF FB(150 1800)
  ST-NUMBER  1  5 N
  ST-UNIT    6  3 N
  ST-GROSS 100  4 P 2 MASK('$$$,$$9.99') HEADING('GROSS' 'PAY')
  ST-STATE 120  1 A
FILE OUTPAY FB(80 800)
  OP-NUMBER  1  5 N
  OP-UNIT    6  3 N
  OP-YEAR   25  6 P 2
  OP-GRADE  31  1 A
DEFINE YEARLY W 6 P 2
DEFINE GRADE W 1 A
DEFINE SEEN W 4 P 0
JOB INPUT STAFF NAME PAYRUN FINISH SHOW-TOTAL
IF ST-STATE = 'A'
  YEARLY = ST-GROSS * 12
  IF YEARLY > 50000
    GRADE = 'H'
  ELSE
    GRADE = 'L'
  END-IF
  MOVE ST-NUMBER TO OP-NUMBER
  MOVE ST-UNIT TO OP-UNIT
  OP-YEAR = YEARLY
  OP-GRADE = GRADE
  SEEN = SEEN + 1
  PUT OUTPAY
  PRINT PAYLIST
END-IF
SHOW-TOTAL. PROC
  DISPLAY 'SEEN' SEEN
END-PROC
REPORT PAYLIST LINESIZE 132
  SEQUENCE ST-UNIT ST-NUMBER D
  CONTROL FINAL ST-UNIT NEWPAGE
  SUM ST-GROSS
  TITLE 1 'PAY BY UNIT' ST-UNIT
  LINE 1 ST-NUMBER +3 ST-GROSS
"""

SORTED = """FILE SALES FB(100 1000)
  SA-AREA 1 2 A
  SA-AMOUNT 22 7 P 2
FILE WORK FB(100 1000)
  COPY SALES
SORT SALES TO WORK USING (SA-AREA SA-AMOUNT D) NAME ORDERED
JOB INPUT WORK NAME LISTING
  PRINT TOTALS
REPORT TOTALS SUMMARY
  CONTROL SA-AREA
  SUM SA-AMOUNT
  LINE SA-AREA SA-AMOUNT
"""

UPDATE = """FILE MOVES FB(120 1200)
  MV-KEY 1 9 N
  MV-CODE 10 1 A
  MV-SUM 11 5 P 2
FILE MASTER VS UPDATE
  MA-KEY 1 9 N
  MA-BALANCE 10 5 P 2
FILE ERRORS FB(133 1330) PRINTER EXIT(ERRTRAP)
  ER-TEXT 1 132 A
FILE CODES TABLE INSTREAM
  CO-CODE 1 1 A
  CO-NAME 3 20 A
'A' 'ADD'
'D' 'DROP'
ENDTABLE
DEFINE WS-NAME W 20 A
DEFINE WS-BALANCE W 5 P 2
JOB INPUT MOVES NAME APPLY
  POINT MASTER EQ MV-KEY
  GET MASTER
  SEARCH CODES WITH MV-CODE GIVING WS-NAME
  CASE MV-CODE
  WHEN 'A'
    WS-BALANCE = MA-BALANCE + MV-SUM
  WHEN 'D'
    WS-BALANCE = 0
  OTHERWISE
    MOVE WS-NAME TO ER-TEXT
    PUT ERRORS
  END-CASE
  MA-BALANCE = WS-BALANCE
  CALL AUDIT USING(WS-BALANCE)
  WRITE MASTER UPDATE
"""

MACRO_USER = """FILE EDITS FB(200 2000)
%LAYOUT 1
FILE GOOD FB(200 2000)
%LAYOUT 1
DEFINE WS-BAD W 2 N 0
JOB INPUT EDITS NAME EDITING
  %RULES
  MOVE LIKE EDITS GOOD
  PUT GOOD
"""
MEMBERS = {"LAYOUT": "MACRO 1 AT\n  CU-KEY &AT 9 N\n  CU-NAME * 30 A\n  CU-STATE * 2 A\n", "RULES": "  IF CU-STATE = 'XX'\n    %COUNTED\n  END-IF\n", "COUNTED": "    WS-BAD = WS-BAD + 1\n"}

SQL_HOST = """FILE LEDGER SQL (SELECT A FROM GLDB.LEDGER)
DEFINE HOSTED W 5 P 2
FILE OUT FB(10 100)
  OU-X 1 5 P 2
JOB INPUT NULL NAME QUERY
  SQL SELECT AMOUNT INTO :HOSTED FROM GLDB.TRANS JOIN GLDB.ACCTS
  OU-X = HOSTED
  PUT OUT
"""


def fan(n: int, behind: bool) -> str:
    """n constant branches, direct or behind one more hop."""
    lines = ["FILE OUT FB(10 100)", "  OU-X 1 1 A", "FILE IN FB(10 100)", "  IN-T 1 3 N", "DEFINE VIA W 1 A", "JOB INPUT IN NAME FAN"]
    target = "VIA" if behind else "OU-X"
    for i in range(n):
        lines += [f"IF IN-T = {i}", f"  {target} = '{i % 10}'", "END-IF"]
    if behind:
        lines += ["OU-X = VIA", "IF IN-T = 999", "  OU-X = VIA", "END-IF"]
    return "\n".join([*lines, "PUT OUT"]) + "\n"
