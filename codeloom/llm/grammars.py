"""Grammars of the languages whose files are checked, written for ``glr.Tables``.

Quoted symbols and all-capital names are tokens of ``lexers``.  Operators of one arity form one
token class, since only membership in the language counts, not the tree.  Rules marked with a
leading ``@ts`` or ``@js`` line prefix belong to that variant of ECMAScript only.
"""

from __future__ import annotations

from functools import lru_cache

from .glr import Tables

# Words that are keywords only in places; each list also feeds the lexers.  Fixed values.
JS_RESERVED = (
    "break case catch class const continue debugger default delete do else export extends false finally for function if "
    "import in instanceof new null return super switch this throw true try typeof var void while with yield enum await let"
).split()
JS_SOFT = "async get set static of from as".split()
TS_SOFT = (
    "type interface namespace module declare abstract implements private protected public readonly override keyof infer is "
    "asserts satisfies unique accessor global any number string boolean symbol never unknown object bigint out require undefined"
).split()
JAVA_RESERVED = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final "
    "finally float for goto if implements import instanceof int interface long native new package private protected public "
    "return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _"
).split()
JAVA_SOFT = "var yield record sealed permits non-sealed module open with to exports opens requires uses provides transitive".split()
CS_RESERVED = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else "
    "enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long "
    "namespace new null object operator out override params private protected public readonly ref return sbyte sealed short "
    "sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual "
    "void volatile while"
).split()
CS_SOFT = (
    "add alias and ascending async await by descending dynamic equals file from get global group init into join let managed "
    "nameof not notnull on or orderby partial record remove required scoped select set unmanaged value var when where with yield"
).split()
PY_RESERVED = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield"
).split()
PY_SOFT = "match case type _".split()


def _any(words: list[str]) -> str:
    return " | ".join(f"'{w}'" for w in words)


def _suffixes(base: str) -> str:
    """Member, call and template suffixes of an operand; written out for both kinds of operand."""
    return f"""
Mem{base} = Prim{base}
    | Mem{base} '.' PropName | Mem{base} '?.' PropName | Mem{base} '?.' '[' Expr ']' | Mem{base} '?.' Args
    | Mem{base} '[' Expr ']' | Mem{base} Args | Mem{base} TPL
@ts | Mem{base} '!' | Mem{base} TypeArgs Args | Mem{base} TypeArgs TPL | Mem{base} '?.' TypeArgs Args | Mem{base} TypeArgs
    ;
Un{base} = Mem{base} | Mem{base} INC ;
Bin{base} = Un{base} | PreOp Unary | INC Unary | PREINC Unary | SIGN Unary | 'await' Unary
    | Bin{base} Op Unary
@ts | Bin{base} 'as' Type | Bin{base} 'satisfies' Type
    ;
As{base} = Bin{base} | Mem{base} '=' Assign | Mem{base} ASSIGN Assign | Bin{base} '?' Assign ':' Assign | 'yield' [ ['*'] Assign ]
    | Ident '=>' ArrowBody | 'async' Ident '=>' ArrowBody
    | Parens '=>' ArrowBody | 'async' Parens '=>' ArrowBody
    ;
Expr{base} = As{base} | Expr{base} ',' Assign ;
"""


ECMA = (
    """
Program = Item* ;
Item = Stmt | ImportDecl | ExportDecl ;
End = ';' | AUTO ;
Ident = ID | """ + _any(JS_SOFT) + """
@ts | """ + _any(TS_SOFT) + """
    ;
PropName = Ident | """ + _any(JS_RESERVED) + """ | PRIVATE ;
Stmt = Block | VarDecl End | Func | Class | ';' | ExprS End
    | 'if' '(' Expr ')' Stmt ['else' Stmt]
    | 'for' '(' [ForInit] ';' [Expr] ';' [Expr] ')' Stmt
    | 'for' ['await'] '(' ForHead ( 'of' Assign | 'in' Expr ) ')' Stmt
    | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' [';']
    | 'return' [Expr] End | 'throw' Expr End | 'break' [Ident] End | 'continue' [Ident] End | 'debugger' End
    | 'try' Block Catch [Finally] | 'try' Block Finally
    | 'switch' '(' Expr ')' '{' Case* '}'
    | Ident ':' Stmt | 'with' '(' Expr ')' Stmt
@ts | TsDecl
    ;
Catch = 'catch' ['(' Binding ')'] Block ;
Finally = 'finally' Block ;
Case = ( 'case' Expr | 'default' ) ':' Stmt* ;
Block = '{' Stmt* '}' ;
VarKind = 'var' | 'let' | 'const' ;
VarDecl = VarKind Declarator % ',' ;
ForInit = VarDecl | Expr ;
ForHead = VarKind Pattern | Mem ;
Declarator = Pattern Annot ['=' Assign] ;
Pattern = Ident | '{' [PatProps] '}' | '[' PatElems ']'
@ts | Ident '!'
    ;
PatProps = PatProp % ',' [','] ;
PatProp = Ident ['=' Assign] | Key ':' Pattern ['=' Assign] | '...' Pattern ;
PatElems = [PatElem] | PatElems ',' [PatElem] ;
PatElem = Pattern ['=' Assign] | '...' Pattern ;
Binding = Pattern Annot ;
Param = Mods Pattern Opt Annot ['=' Assign] | '...' Pattern Annot
@ts | 'this' Annot
    ;
Parens = TypeParams '(' [Param % ',' [',']] ')' RetType ;
Func = ['async'] 'function' ['*'] Ident Parens FuncBody ;
FuncExpr = ['async'] 'function' ['*'] [Ident] Parens Block ;
FuncBody = Block
@ts | End
    ;
ArrowBody = Block | AssignNoBrace ;
AssignNoBrace = AsA ;
Class = Decos 'class' Ident TypeParams Heritage ClassBody
@ts | Decos 'abstract' 'class' Ident TypeParams Heritage ClassBody
    ;
ClassExpr = Decos 'class' [Ident] TypeParams Heritage ClassBody ;
Heritage = ['extends' Mem]
@ts | ['extends' Mem] 'implements' Type % ','
    ;
ClassBody = '{' Member* '}' ;
Member = ';' | 'static' Block
    | Decos Mods Key Opt Parens FuncBody
    | Decos Mods 'async' ['*'] Key Parens FuncBody
    | Decos Mods '*' Key Parens FuncBody
    | Decos Mods ( 'get' | 'set' ) Key Parens FuncBody
    | Decos Mods Key Opt Annot ['=' Assign] End
@ts | Decos Mods Key '!' Annot End | Mods '[' Ident ':' Type ']' Annot End
    ;
Mods = 
@js | 'static'
@ts | Mods Mod
    ;
@ts Mod = 'static' | 'private' | 'protected' | 'public' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor' ;
Decos = | Decos '@' DecoExpr ;
DecoExpr = Ident | DecoExpr '.' PropName | DecoExpr Args ;
Key = PropName | STR | NUM | '[' Assign ']' ;
Prim = PrimS | '{' [Prop % ',' [',']] '}' | FuncExpr | ClassExpr
@tscast | TypeArgs Unary
    ;
PrimA = PrimS | FuncExpr | ClassExpr ;
PrimS = Ident | NUM | STR | TPL | REGEX | 'this' | 'null' | 'true' | 'false' | 'super' | '(' Expr ')' | '[' Elems ']'
    | 'new' NewTarget [Args] | 'new' '.' Ident | 'import' Args | 'import' '.' Ident | JSX | PRIVATE
    ;
NewTarget = NewPrim | NewTarget '.' PropName | NewTarget '[' Expr ']'
@ts | NewTarget TypeArgs
    ;
NewPrim = Ident | 'this' | '(' Expr ')' | FuncExpr | ClassExpr | 'new' NewTarget Args | 'new' '.' Ident | 'super' ;
Elems = [Elem] | Elems ',' [Elem] ;
Elem = Assign | '...' Assign ;
Args = '(' [Elem % ',' [',']] ')' ;
Prop = Ident ['=' Assign] | Key ':' Assign | '...' Assign | Key Parens Block | 'async' ['*'] Key Parens Block | '*' Key Parens Block
    | ( 'get' | 'set' ) Key Parens Block ;
Op = BIN | SIGN | '*' | '<' | '>' | '|' | '&' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof' ;
Assign = As ;
Unary = Un | PreOp Unary | INC Unary | PREINC Unary | SIGN Unary | 'await' Unary ;
PreOp = '!' | '~' | 'typeof' | 'void' | 'delete' ;
"""
    + _suffixes("")
    + _suffixes("S")
    + _suffixes("A")
    + """
ImportDecl = 'import' STR Attrs End | 'import' ImpClause 'from' STR Attrs End
@ts | 'import' 'type' ImpClause 'from' STR Attrs End | 'import' ['type'] Ident '=' 'require' '(' STR ')' End | 'import' Ident '=' TypeName End
    ;
Attrs = [ 'with' '{' [Prop % ',' [',']] '}' ] ;
ImpClause = Ident | Named | '*' 'as' Ident | Ident ',' Named | Ident ',' '*' 'as' Ident ;
Named = '{' [Spec % ',' [',']] '}' ;
Spec = SpecName ['as' SpecName]
@ts | 'type' SpecName ['as' SpecName]
    ;
SpecName = PropName | STR ;
ExportDecl = 'export' Named ['from' STR Attrs] End | 'export' '*' ['as' SpecName] 'from' STR Attrs End
    | 'export' VarDecl End | 'export' Func | Decos 'export' Class | 'export' 'default' ExportDefault
@ts | 'export' TsDecl | 'export' 'type' Named ['from' STR] End | 'export' 'type' '*' ['as' Ident] 'from' STR End
@ts | 'export' '=' Expr End | 'export' 'as' 'namespace' Ident End
    ;
ExportDefault = AsS End | 'async' 'function' Parens Block | 'function' ['*'] [Ident] Parens FuncBody | 'async' 'function' Ident Parens Block | Decos 'class' [Ident] TypeParams Heritage ClassBody
    | '{' [Prop % ',' [',']] '}' End
@ts | 'abstract' 'class' Ident TypeParams Heritage ClassBody | Interface
    ;
@js Annot = ;
@js Opt = ;
@js RetType = ;
@js TypeParams = ;
@ts Annot = | ':' Type ;
@ts Opt = | '?' ;
@ts RetType = | ':' RetT ;
@ts RetT = Type | Ident 'is' Type | 'this' 'is' Type | 'asserts' Ident ['is' Type] ;
@ts TypeParams = | '<' TParam % ',' [','] '>' ;
@ts TParam = ['const'] Ident ['extends' Type] ['=' Type] | 'in' Ident | 'out' Ident ;
@ts TypeArgs = '<' Type % ',' '>' ;
@ts Type = Union | Union 'extends' Union '?' Type ':' Type | FnType ;
@ts FnType = TypeParams '(' [Param % ',' [',']] ')' '=>' RetT | ['abstract'] 'new' TypeParams '(' [Param % ',' [',']] ')' '=>' Type ;
@ts Union = ['|'] Inter | Union '|' Inter ;
@ts Inter = ['&'] TOp | Inter '&' TOp ;
@ts TOp = TPost | 'keyof' TOp | 'unique' TOp | 'readonly' TOp | 'infer' Ident ['extends' TPost] ;
@ts TPost = TPrim | TPost '[' ']' | TPost '[' Type ']' ;
@ts TypeName = Ident | TypeName '.' PropName ;
@ts TPrim = TypeName [TypeArgs] | 'void' | 'null' | 'true' | 'false' | 'this' | STR | NUM | SIGN NUM | TPL | '(' Type ')' | '[' [TElem % ',' [',']] ']'
@ts     | '{' TMember* '}' | '{' Mapped '}' | 'typeof' TypeQ [TypeArgs] | 'import' '(' STR ')' | 'import' '(' STR ')' '.' TypeName [TypeArgs] ;
@ts TypeQ = Ident | 'this' | TypeQ '.' PropName | 'import' '(' STR ')' ;
@ts TElem = ['...'] Type ['?'] | ['...'] Ident Opt ':' Type ;
@ts TSep = ';' | ',' | AUTO ;
@ts TMember = TMods Key Opt Annot TSep | TMods Key Opt TypeParams '(' [Param % ',' [',']] ')' RetType TSep
@ts     | TypeParams '(' [Param % ',' [',']] ')' RetType TSep | 'new' TypeParams '(' [Param % ',' [',']] ')' RetType TSep
@ts     | TMods '[' Ident ':' Type ']' Annot TSep | ( 'get' | 'set' ) Key '(' [Param % ',' [',']] ')' RetType TSep ;
@ts TMods = | 'readonly' ;
@ts Mapped = MapMod '[' Ident 'in' Type ['as' Type] ']' MapOpt [':' Type] TSep ;
@ts MapMod = | 'readonly' | SIGN 'readonly' ;
@ts MapOpt = | '?' | SIGN '?' ;
@ts Interface = 'interface' Ident TypeParams ['extends' Type % ','] '{' TMember* '}' ;
@ts TsDecl = Interface | 'type' Ident TypeParams '=' Type End | ['const'] 'enum' Ident '{' [EnumM % ',' [',']] '}'
@ts     | ( 'namespace' | 'module' ) TypeName '{' Item* '}' | 'module' STR '{' Item* '}' | 'global' '{' Item* '}'
@ts     | 'declare' Amb | Decos 'export' 'abstract' 'class' Ident TypeParams Heritage ClassBody ;
@ts Amb = VarDecl End | ['async'] 'function' ['*'] Ident Parens End | Class | TsDecl | 'module' STR End ;
@ts EnumM = Key ['=' Assign] ;
"""
)

JAVA = """
Unit = Annos 'package' QName ';' Import* TopDecl* | Import* TopDecl* | Annos ['open'] 'module' QName '{' ModDir* '}' ;
ModDir = 'requires' ['transitive'] ['static'] QName ';' | ( 'exports' | 'opens' ) QName ['to' QName % ','] ';' | 'uses' QName ';' | 'provides' QName 'with' QName % ',' ';' ;
Import = 'import' ['static'] QName ['.' '*'] ';' ;
Ident = ID | """ + _any(JAVA_SOFT[:1] + JAVA_SOFT[1:5] + JAVA_SOFT[6:]) + """ ;
QName = Ident | QName '.' Ident ;
Annos = | Annos Anno ;
Anno = '@' QName ['(' [AnnoArgs] ')'] ;
AnnoArgs = AnnoVal | ( Ident '=' AnnoVal ) % ',' ;
AnnoVal = Tern | Anno | '{' [AnnoVal % ','] [','] '}' ;
Mods = | Mods Mod ;
Mod = Anno | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed' ;
TopDecl = TypeDecl | ';' ;
TypeDecl = Mods 'class' Ident TParams ['extends' Type] ['implements' Types] ['permits' Types] ClassBody
    | Mods 'interface' Ident TParams ['extends' Types] ['permits' Types] ClassBody
    | Mods 'enum' Ident ['implements' Types] '{' [EnumC % ','] [','] [ ';' Member* ] '}'
    | Mods 'record' Ident TParams '(' [RecC % ','] ')' ['implements' Types] ClassBody
    | Mods '@' 'interface' Ident ClassBody ;
RecC = Annos Type ['...'] Ident ;
EnumC = Annos Ident [Args] [ClassBody] ;
Types = Type % ',' ;
TParams = | '<' TParam % ',' '>' ;
TParam = Annos Ident [ 'extends' Type ( '&' Type )* ] ;
ClassBody = '{' Member* '}' ;
Member = ';' | TypeDecl | Block | 'static' Block
    | Mods Type Declarators ';'
    | Mods TParams Result Ident Formals Dims ['throws' Types] MBody
    | Mods TParams Ident Formals ['throws' Types] Block
    | Mods Ident Block ;
Result = Type | 'void' ;
MBody = Block | ';' | 'default' AnnoVal ';' ;
Formals = '(' [Formal % ','] ')' ;
Formal = FMods Type [Annos '...'] Ident Dims | FMods Type [ Ident '.' ] 'this' ;
FMods = | FMods ( Anno | 'final' ) ;
Dims = | Dims Annos '[' ']' ;
Declarators = Declarator % ',' ;
Declarator = Ident Dims ['=' VarInit] ;
VarInit = Expr | ArrInit ;
ArrInit = '{' [VarInit % ','] [','] '}' ;
Type = Base Dims ;
Base = PrimT | ClassT | Anno Base ;
PrimT = 'boolean' | 'byte' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' ;
ClassT = Ident [TArgs] | ClassT '.' Annos Ident [TArgs] ;
TArgs = '<' [TArg % ','] '>' ;
TArg = Type | Annos '?' [ ( 'extends' | 'super' ) Type ] ;
Block = '{' BStmt* '}' ;
BStmt = Stmt | LocalVar ';' | TypeDecl ;
LocalVar = FMods Type Declarators ;
Stmt = Block | ';' | StmtExpr ';' | Ident ':' Stmt
    | 'if' '(' Expr ')' Stmt ['else' Stmt] | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
    | 'for' '(' [ForInit] ';' [Expr] ';' [StmtExpr % ','] ')' Stmt | 'for' '(' FMods Type Ident Dims ':' Expr ')' Stmt
    | 'return' [Expr] ';' | 'throw' Expr ';' | 'break' [Ident] ';' | 'continue' [Ident] ';' | 'yield' Expr ';'
    | 'assert' Expr [':' Expr] ';' | 'synchronized' '(' Expr ')' Block
    | 'try' Block Catch+ | 'try' Block Catch* 'finally' Block | 'try' '(' Res % ';' [';'] ')' Block Catch* ['finally' Block]
    | Switch ;
Catch = 'catch' '(' FMods Type ( '|' Type )* Ident ')' Block ;
Res = FMods Type Ident '=' Expr | Postfix ;
ForInit = LocalVar | StmtExpr % ',' ;
StmtExpr = Postfix AssignOp Expr | INC Unary | Postfix INC | Call | NewExpr ;
AssignOp = '=' | ASSIGN ;
Switch = 'switch' '(' Expr ')' '{' SwBody '}' ;
SwBody = | SwGroup+ ( SwLabel ':' )* | SwRule+ ;
SwGroup = ( SwLabel ':' )+ BStmt+ ;
SwLabel = 'case' CaseL % ',' | 'default' ;
CaseL = Tern | 'default' | FMods Type Ident ;
SwRule = SwLabel '->' ( Expr ';' | Block | 'throw' Expr ';' ) ;
Expr = Tern | Postfix AssignOp Expr | Lambda ;
Lambda = Ident '->' LBody | '(' [Ident % ','] ')' '->' LBody | '(' Formal % ',' ')' '->' LBody ;
LBody = Expr | Block ;
Tern = Bin | Bin '?' Expr ':' Tern | Bin '?' Expr ':' Lambda ;
Bin = Unary | Bin Op Unary | Bin 'instanceof' FMods Type [Ident] ;
Op = BIN | SIGN | '*' | '<' | '>' | '&' | '|' | '>' '>' | '>' '>' '>' ;
Unary = Postfix | Postfix INC | INC Unary | PRE Unary | SIGN Unary | '(' Type ( '&' Type )* ')' CastArg ;
CastArg = Unary | Lambda ;
Postfix = Prim | QName ;
Prim = LIT | 'this' | '(' Expr ')' | NewExpr | Call | Postfix '.' Ident | Postfix '[' Expr ']' | Postfix '.' 'this' | Postfix '.' 'class'
    | Type '.' 'class' | 'void' '.' 'class' | 'super' '.' Ident | Postfix '.' 'super' '.' Ident | MRef | Switch
    | 'new' NewBase ArrDims Dims | 'new' NewBase '[' ']' Dims ArrInit ;
NewBase = PrimT | ClassT | Anno NewBase ;
ArrDims = ( '[' Expr ']' )+ ;
MRef = Postfix '::' [TArgs] Ident | Type '::' [TArgs] ( Ident | 'new' ) | 'super' '::' Ident ;
Call = Ident Args | 'this' Args | 'super' Args | Postfix '.' [TArgs] Ident Args | 'super' '.' [TArgs] Ident Args | Postfix '.' 'super' Args | Postfix '.' 'super' '.' Ident Args ;
NewExpr = 'new' [TArgs] NewBase Args [ClassBody] | Postfix '.' 'new' Ident [TArgs] Args [ClassBody] ;
Args = '(' [Expr % ','] ')' ;
"""

CSHARP = """
Unit = Extern* Using* GAttr* Top* ;
Extern = 'extern' 'alias' Ident ';' ;
Using = ['global'] 'using' ['static'] TypeN ';' | ['global'] 'using' ['unsafe'] Ident '=' Type ';' ;
GAttr = '[' Ident ':' Attr % ',' [','] ']' ;
Top = Namespace | TypeDecl | Stmt ;
Namespace = 'namespace' QName '{' Extern* Using* NsMember* '}' [';'] | 'namespace' QName ';' Using* NsMember* ;
NsMember = Namespace | TypeDecl ;
Ident = ID | """ + _any(CS_SOFT) + """ ;
QName = Ident | QName '.' Ident ;
Attrs = | Attrs '[' [Target ':'] Attr % ',' [','] ']' ;
Target = Ident | 'return' | 'event' ;
Attr = TypeN ['(' [AArg % ','] ')'] ;
AArg = [Ident '='] Expr | Ident ':' Expr ;
Mods = | Mods Mod ;
Mod = 'public' | 'private' | 'protected' | 'internal' | 'static' | 'readonly' | 'sealed' | 'abstract' | 'virtual' | 'override' | 'new' | 'extern' | 'unsafe' | 'volatile' | 'async' | 'partial' | 'const' | 'ref' | 'required' | 'file' | 'fixed' ;
TypeDecl = Attrs Mods 'class' Ident TParams [Prim0] Bases Cons TBody
    | Attrs Mods 'struct' Ident TParams [Prim0] Bases Cons TBody
    | Attrs Mods 'interface' Ident TParams Bases Cons TBody
    | Attrs Mods 'record' ['class' | 'struct'] Ident TParams [Prim0] Bases Cons TBody
    | Attrs Mods 'enum' Ident [':' Type] '{' [EnumM % ',' [',']] '}' [';']
    | Attrs Mods 'delegate' RType Ident TParams Formals Cons ';' ;
Prim0 = Formals ;
TBody = '{' Member* '}' [';'] | ';' ;
EnumM = Attrs Ident ['=' Expr] ;
TParams = | '<' TParam % ',' '>' ;
TParam = Attrs ['in' | 'out'] Ident ;
Bases = | ':' Base % ',' ;
Base = Type [Args] ;
Cons = | Cons 'where' Ident ':' Con % ',' ;
Con = Type | 'class' | 'class' '?' | 'struct' | 'new' '(' ')' | 'default' ;
Member = TypeDecl
    | Attrs Mods Type Declrs ';' | Attrs Mods 'event' Type Declrs ';' | Attrs Mods 'event' Type MName '{' Acc Acc '}'
    | Attrs Mods RType MName TParams Formals Cons MBody
    | Attrs Mods Ident Formals [ ':' ( 'base' | 'this' ) Args ] MBody
    | Attrs Mods '~' Ident '(' ')' MBody
    | Attrs Mods RType MName PBody
    | Attrs Mods RType [TypeN '.'] 'this' '[' Formal % ',' ']' PBody
    | Attrs Mods RType 'operator' ['checked'] OvOp Formals MBody
    | Attrs Mods ( 'implicit' | 'explicit' ) 'operator' ['checked'] Type Formals MBody ;
OvOp = BIN | SIGN | '!' | '~' | INC | '*' | '<' | '>' | '&' | '|' | '>' '>' | 'true' | 'false' | '<' '<' | '^' ;
MName = Ident | TypeN '.' Ident ;
RType = Type | 'void' | 'ref' ['readonly'] Type ;
MBody = Block | '=>' Expr ';' | ';' ;
PBody = '{' Acc+ '}' ['=' VarInit ';'] | '=>' Expr ';' ;
Acc = Attrs [AccMod] ['readonly'] ( 'get' | 'set' | 'init' | 'add' | 'remove' ) ( Block | ';' | '=>' Expr ';' ) ;
AccMod = 'private' | 'protected' | 'internal' | 'protected' 'internal' | 'private' 'protected' ;
Formals = '(' [Formal % ','] ')' ;
Formal = Attrs FMod* Type Ident ['=' Expr] ;
FMod = 'ref' | 'out' | 'in' | 'this' | 'params' | 'readonly' | 'scoped' ;
Declrs = Declr % ',' ;
Declr = Ident ['[' Expr ']'] ['=' VarInit] ;
VarInit = Expr | ArrInit | 'ref' Expr | 'stackalloc' StackA ;
ArrInit = '{' [VarInit % ',' [',']] '}' ;
PreT = 'bool' | 'byte' | 'char' | 'decimal' | 'double' | 'float' | 'int' | 'long' | 'object' | 'sbyte' | 'short' | 'string' | 'uint' | 'ulong' | 'ushort' ;
TypeN = Ident [TArgs] | Ident '::' Ident [TArgs] | TypeN '.' Ident [TArgs] ;
TArgs = '<' Type % ',' '>' | '<' ','* '>' ;
Type = TypeN | PreT | Type '?' | Type '[' ','* ']' | Type '*' | 'void' '*' | '(' TupE ',' TupE % ',' ')' | 'delegate' '*' '<' RType % ',' '>' ;
TupE = Type [Ident] ;
Block = '{' Stmt* '}' ;
Stmt = Block | ';' | Local ';' | 'const' Type Declrs ';' | StmtExpr ';' | Ident ':' Stmt | LocalFn
    | 'if' '(' Expr ')' Stmt ['else' Stmt] | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
    | 'for' '(' [ForInit] ';' [Expr] ';' [StmtExpr % ','] ')' Stmt
    | ['await'] 'foreach' '(' ForVar 'in' Expr ')' Stmt
    | 'return' [ ['ref'] Expr ] ';' | 'throw' [Expr] ';' | 'break' ';' | 'continue' ';' | 'goto' ( Ident | 'case' Expr | 'default' ) ';'
    | 'yield' 'return' Expr ';' | 'yield' 'break' ';'
    | 'try' Block Catch+ ['finally' Block] | 'try' Block 'finally' Block
    | 'switch' '(' Expr [',' Arg % ','] ')' '{' Section* '}' | 'lock' '(' Expr ')' Stmt
    | ['await'] 'using' '(' ( Local | Expr ) ')' Stmt | ['await'] 'using' Local ';'
    | 'checked' Block | 'unchecked' Block | 'unsafe' Block | 'fixed' '(' Local ')' Stmt ;
Local = ['scoped'] ['ref' ['readonly']] Type Declrs ;
LocalFn = Attrs FnMod* RType Ident TParams Formals Cons ( Block | '=>' Expr ';' | ';' ) ;
FnMod = 'static' | 'async' | 'unsafe' | 'extern' ;
ForVar = ['ref' ['readonly']] Type Ident | 'var' Tuple | Tuple ;
Tuple = '(' TupV ',' TupV % ',' ')' ;
TupV = Ident | Type Ident | Tuple ;
ForInit = Local | StmtExpr % ',' ;
Catch = 'catch' ['(' Type [Ident] ')'] ['when' '(' Expr ')'] Block ;
Section = SLabel+ Stmt+ ;
SLabel = 'case' Pat ['when' Expr] ':' | 'default' ':' ;
StmtExpr = Assignment | Call | INC Unary | Post INC | 'await' Unary | NewObj | Post '!' ;
Assignment = Unary ( '=' | ASSIGN ) ( Expr | 'ref' Expr ) | '(' DeclE ',' DeclE % ',' ')' '=' Expr | 'var' Tuple '=' Expr ;
DeclE = Type Ident | Expr ;
Expr = Cond | Assignment | Lambda | Query | 'throw' Expr ;
Lambda = Attrs LMod* LParams '=>' ( Expr | Block ) | 'delegate' [Formals] Block | LMod* 'delegate' [Formals] Block ;
LMod = 'async' | 'static' ;
LParams = Ident | '(' [Ident % ','] ')' | '(' Formal % ',' ')' | Type '(' [Formal % ','] ')' ;
Cond = Bin | Bin '?' Branch ':' Branch | Bin '??' Branch ;
Branch = Cond | 'throw' Expr | 'ref' Expr | Lambda | Assignment ;
Bin = Unary | Bin Op Unary | Bin 'is' Pat | Bin 'as' Type | Bin 'switch' '{' [SwArm % ',' [',']] '}' | Bin 'with' '{' [MInit % ',' [',']] '}' ;
SwArm = Pat ['when' Cond] '=>' Expr ;
Op = BIN | SIGN | '*' | '<' | '>' | '&' | '|' | '^' | '<' '<' | '>' '>' | '>' '>' '>' | '..' ;
Pat = PatAnd | Pat 'or' PatAnd ;
PatAnd = PatN | PatAnd 'and' PatN ;
PatN = PatP | 'not' PatN ;
PatP = Type | Bin | Type Ident | 'var' Ident | 'var' Tuple | [Type] '{' [SubP % ',' [',']] '}' [Ident] | [Type] '(' [SubP % ','] ')' ['{' [SubP % ',' [',']] '}'] [Ident]
    | ( '<' | '>' | BIN ) Unary | '(' Pat ')' | '[' [Pat % ',' [',']] ']' [Ident] | '..' [Pat] ;
SubP = Pat | QName ':' Pat ;
Unary = Post | Post INC | INC Unary | '!' Unary | '~' Unary | SIGN Unary | '&' Unary | '*' Unary | '^' Unary | 'await' Unary | '(' Type ')' Unary | '..' Unary ;
Post = LIT | Ident | Ident TArgs | Ident '::' Ident | PreT | 'this' | 'base' | '(' Expr ')' | '(' TupA ',' TupA % ',' ')' | Call | NewObj
    | Post '.' Ident [TArgs] | Post '?' '.' Ident [TArgs] | Post '->' Ident | Post '[' Arg % ',' ']' | Post '?' '[' Arg % ',' ']' | Post '!'
    | 'typeof' '(' RType ')' | 'sizeof' '(' Type ')' | 'default' ['(' Type ')'] | 'checked' '(' Expr ')' | 'unchecked' '(' Expr ')'
    | '[' [CElem % ',' [',']] ']' | 'stackalloc' StackA ;
StackA = Type '[' [Expr] ']' [ArrInit] | '[' ']' ArrInit ;
CElem = Expr | '..' Expr ;
TupA = [Ident ':'] Expr | Type Ident ;
Call = Post Args ;
Args = '(' [Arg % ','] ')' ;
Arg = [Ident ':'] ArgV ;
ArgV = Expr | ( 'ref' | 'out' | 'in' ) Expr | 'out' Type Ident ;
NewObj = 'new' Type Args [OInit] | 'new' Type OInit | 'new' Args [OInit] | 'new' NType Ranks RankT ArrOpt | 'new' RankE ArrInit | 'new' OInit | 'new' Type ArrInit ;
NType = TypeN | PreT | NType '?' ;
Ranks = '[' Expr % ',' ']' ;
RankT = | RankT RankE ;
RankE = '[' ','* ']' ;
ArrOpt = | ArrInit ;
OInit = '{' [MInit % ',' [',']] '}' ;
MInit = Ident '=' InitV | '[' Arg % ',' ']' '=' InitV | Expr | '{' Expr % ',' [','] '}' ;
InitV = Expr | OInit | 'ref' Expr ;
Query = 'from' [Type] Ident 'in' Expr QBody ;
QBody = QClause* ( 'select' Expr | 'group' Expr 'by' Expr ) ['into' Ident QBody] ;
QClause = 'from' [Type] Ident 'in' Expr | 'let' Ident '=' Expr | 'where' Expr | 'orderby' ( Expr ['ascending' | 'descending'] ) % ','
    | 'join' [Type] Ident 'in' Expr 'on' Expr 'equals' Expr ['into' Ident] ;
"""

PYTHON = """
File = ( NL | Stmt )* ;
Stmt = Simple | Compound ;
Simple = Small % ';' [';'] NL ;
Ident = ID | """ + _any(PY_SOFT) + """ ;
Small = Stars | One ':' Test ['=' Value] | Targets Value | One ASSIGN Value | Yield | 'pass' | 'break' | 'continue'
    | 'del' Dels | 'return' [Stars] | 'raise' [Test ['from' Test]] | 'global' Ident % ',' | 'nonlocal' Ident % ','
    | 'assert' Test [',' Test] | 'import' ( Dotted ['as' Ident] ) % ',' | 'from' FromWhat 'import' ImportList
    | 'type' Ident TParams '=' Test ;
Targets = ( Goals '=' )+ ;
Goals = Goal % ',' [','] ;
Goal = Place | '*' Place ;
Place = Spot | '(' [Goals] ')' | '[' [Goals] ']' ;
Spot = Ident | Prim '.' Ident | Prim '[' Subs ']' ;
One = Spot | '(' One ')' ;
Dels = Del % ',' [','] ;
Del = Spot | '(' [Dels] ')' | '[' [Dels] ']' ;
Value = Stars | Yield ;
FromWhat = Dots Dotted | Dots0 ;
Dots = | Dots0 ;
Dots0 = '.' | '...' | Dots0 '.' | Dots0 '...' ;
Dotted = Ident | Dotted '.' Ident ;
ImportList = '*' | ( Ident ['as' Ident] ) % ',' | '(' ( Ident ['as' Ident] ) % ',' [','] ')' ;
Compound = IfS | 'while' Named ':' Suite ['else' ':' Suite] | ['async'] 'for' Goals 'in' Stars ':' Suite ['else' ':' Suite]
    | 'try' ':' Suite Except+ ['else' ':' Suite] ['finally' ':' Suite] | 'try' ':' Suite 'finally' ':' Suite
    | ['async'] 'with' WithItems ':' Suite | Decos ['async'] Def | Decos ClassD | Match ;
IfS = 'if' Named ':' Suite Elif* ['else' ':' Suite] ;
Elif = 'elif' Named ':' Suite ;
Except = 'except' ':' Suite | 'except' ['*'] Test ['as' Ident] ':' Suite ;
WithItems = WithItem % ',' | '(' WithItem % ',' [','] ')' ;
WithItem = Test ['as' Place] ;
Decos = | Decos '@' Named NL ;
Def = 'def' Ident TParams '(' [Params] ')' ['->' Test] ':' Suite ;
TParams = | '[' TParam % ',' [','] ']' ;
TParam = Ident [':' Test] ['=' Test] | '*' Ident | '**' Ident ;
ClassD = 'class' Ident TParams ['(' [Args] ')'] ':' Suite ;
Params = PList [','] ;
Req = Ident [':' Test] ;
Dft = Ident [':' Test] '=' Test ;
Reqs = Req % ',' ;
Dfts = Dft % ',' ;
Plain = Reqs | Reqs ',' Dfts | Dfts ;
Front = Plain | Reqs ',' '/' [',' Plain] | Reqs ',' Dfts ',' '/' [',' Dfts] | Dfts ',' '/' [',' Dfts] ;
Keys = ( Req | Dft ) % ',' ;
Rest = '*' Ident [':' Star] [',' Keys] [',' '**' Req] | '*' ',' Keys [',' '**' Req] | '**' Req ;
PList = Front | Front ',' Rest | Rest ;
LParams = LList [','] ;
LReqs = Ident % ',' ;
LDft = Ident '=' Test ;
LDfts = LDft % ',' ;
LPlain = LReqs | LReqs ',' LDfts | LDfts ;
LFront = LPlain | LReqs ',' '/' [',' LPlain] | LReqs ',' LDfts ',' '/' [',' LDfts] | LDfts ',' '/' [',' LDfts] ;
LKeys = ( Ident | LDft ) % ',' ;
LRest = '*' Ident [',' LKeys] [',' '**' Ident] | '*' ',' LKeys [',' '**' Ident] | '**' Ident ;
LList = LFront | LFront ',' LRest | LRest ;
Suite = Simple | NL INDENT Stmt+ DEDENT ;
Match = 'match' Stars ':' NL INDENT CaseB+ DEDENT ;
CaseB = 'case' Pats ['if' Named] ':' Suite ;
Pats = PatAs | PatStar ',' [PatStar % ',' [',']] | '*' Ident ;
PatStar = PatAs | '*' Ident ;
PatAs = PatOr ['as' Ident] ;
PatOr = PatC % '|' ;
PatC = NumP | STR+ | 'None' | 'True' | 'False' | Dotted | '(' [PatStar % ',' [',']] ')' | '[' [PatStar % ',' [',']] ']'
    | '{' [PatKV % ',' [',']] '}' | Dotted '(' [PatArg % ',' [',']] ')' ;
NumP = [SIGN] NUM [SIGN NUM] ;
PatKV = ( NumP | STR+ | Dotted | 'None' | 'True' | 'False' ) ':' PatAs | '**' Ident ;
PatArg = PatAs | Ident '=' PatAs ;
Stars = Star % ',' [','] ;
Star = Test | '*' Test ;
NStars = NStar % ',' [','] ;
NStar = Named | '*' Test ;
Yield = 'yield' [Stars] | 'yield' 'from' Test ;
Named = Test | Ident ':=' Test ;
Test = Bin | Bin 'if' Bin 'else' Test | 'lambda' [LParams] ':' Test ;
Bin = Un | Bin Op Un ;
Op = BIN | SIGN | '*' | '**' | '/' | '|' | '@' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
Un = Power | 'not' Un | SIGN Un | TILDE Un | 'await' Un ;
Power = Prim ;
Prim = Atom | Prim '.' Ident | Prim '(' [Args] ')' | Prim '(' Named Comp ')' | Prim '[' Subs ']' ;
Atom = Ident | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' [NStars] ')' | '(' Yield ')' | '(' Named Comp ')'
    | '[' [NStars] ']' | '[' Named Comp ']' | '{' [NStars] '}' | '{' Named Comp '}' | '{' KV % ',' [','] '}' | '{' Test ':' Test Comp '}' ;
KV = Test ':' Test | '**' Test ;
Comp = CompFor+ ;
CompFor = ['async'] 'for' Goals 'in' Bin CompIf* ;
CompIf = 'if' ( Bin | Ident ':=' Test | 'lambda' [LParams] ':' Test ) ;
Args = Given [','] ;
Given = Pos % ',' | Pos % ',' ',' Kws | Kws ;
Pos = Named | '*' Test ;
Kws = Kws1 | Kws2 ;
Kws1 = Ident '=' Test | Kws1 ',' Ident '=' Test | Kws1 ',' '*' Test ;
Kws2 = '**' Test | Kws1 ',' '**' Test | Kws2 ',' Ident '=' Test | Kws2 ',' '**' Test ;
Subs = Sub % ',' [','] ;
Sub = Named | '*' Test | [Test] ':' [Test] [':' [Test]] ;
"""


def _variant(text: str, tags: set[str]) -> str:
    out = []
    for line in text.split("\n"):
        tag, _, rest = line.partition(" ")
        if tag.startswith("@") and len(tag) > 1:
            if tag[1:] in tags:
                out.append(rest)
        else:
            out.append(line)
    return "\n".join(out)


@lru_cache(maxsize=None)
def tables(lang: str) -> Tables:
    """Tables of js, ts, tsx, java, cs or py; built once per process."""
    if lang in ("js", "ts", "tsx"):
        tags = {"js": {"js"}, "ts": {"ts", "tscast"}, "tsx": {"ts"}}[lang]
        return Tables(_variant(ECMA, tags).replace(" AUTO", " '$auto'"), "Program")
    return Tables({"java": JAVA, "cs": CSHARP, "py": PYTHON}[lang], {"java": "Unit", "cs": "Unit", "py": "File"}[lang])


# Heads of functions, for the generalised LL recogniser; each is parsed on its own from the token
# behind its documentation (in Python: from its def), so the rest of the file may be broken.
ECMA_FN = """
Fn = Decos ['export' ['default']] ['declare'] ['async'] 'function' ['*'] FnName Parens FnEnd
    | Decos ['export'] ['declare'] VarKind FnName Annot '=' FnVal
    | Decos Mods ['async'] ['*'] FnName Opt Parens '{'
    | Decos Mods ( 'get' | 'set' ) FnName Parens '{'
    | Decos Mods FnName Opt Annot '=' FnVal
    | ['async'] ['*'] FnName Parens '{'
    | FnName ':' FnVal
    | FnOwner '.' FnName '=' FnVal
@ts | Decos Mods FnName Opt TypeParams '(' [Param % ',' [',']] ')' ':' RetT ( ';' | ',' )
@ts | Decos Mods Mod FnName Opt Parens ';'
    ;
FnOwner = Ident | 'this' | FnOwner '.' Ident ;
FnVal = ['async'] Parens '=>' | ['async'] Ident '=>' | ['async'] 'function' ['*'] [Ident] Parens '{' ;
FnEnd = '{'
@ts | ';'
    ;
FnName = Ident | PRIVATE | 'delete' | 'default' | 'new' | 'in' | 'import' | 'export' | 'enum' | 'extends' ;
"""
JAVA_FN = """
Fn = Mods TParams Result FnName Formals Dims ['throws' Types] ( '{' | ';' | 'default' ) ;
FnName = Ident ;
"""
CSHARP_FN = """
Fn = Attrs Mods RType FnName TParams Formals Cons ( '{' | ';' | '=>' ) | Attrs Mods RType TypeN '.' FnName TParams Formals Cons ( '{' | '=>' ) ;
FnName = Ident ;
"""
PYTHON_FN = """
Fn = 'def' FnName TParams '(' [Params] ')' ['->' Test] ':' ;
FnName = Ident ;
"""


@lru_cache(maxsize=None)
def machine(lang: str):
    """GLL machine of the function heads of a language, over the token kinds of ``tables``."""
    from .gll import Machine

    t = tables(lang)
    if lang in ("js", "ts", "tsx"):
        tags = {"js": {"js"}, "ts": {"ts", "tscast"}, "tsx": {"ts"}}[lang]
        text = _variant(ECMA_FN + ECMA, tags).replace(" AUTO", " '$auto'")
    else:
        text = {"java": JAVA_FN + JAVA, "cs": CSHARP_FN + CSHARP, "py": PYTHON_FN + PYTHON}[lang]
    return Machine(text, t.terminals, ["Fn"])
