"""Parsing-expression grammars of the languages whose files are checked; see peg for the notation.

Letters stand for the tokens of syntax; brackets, marks and ends of lines are tokens as well. Rules of two kinds that differ in one point are
written once, with a mark in their names that is filled in for each kind.
"""

from __future__ import annotations

from repolith.llm.peg import Grammar

# s string, v number or constant
JSON = Grammar("""
pair <- 's' ':' value
value <- [sv] / '{' (pair (',' pair)*)? '}' / '[' (value (',' value)*)? ']'
file <- value eof
""")

# k bare key, s string, m string of several lines, v other value, ; line end; { and [ of values, < and > around a header, L and R around one of a list
TOML = Grammar("""
key <- [ks] ('.' [ks])*
pair <- key '=' value
list <- '[' ';'* (value ';'* (',' ';'* value ';'*)* (',' ';'*)?)? ']'
value <- [smv] / list / '{' (pair (',' pair)*)? '}'
header <- '<' key '>' / 'L' key 'R'
line <- pair / header
file <- ';'* (line (';'+ line)* ';'*)? eof
""")

# n name, 1 match, 2 case, 3 type, s string, B bytes, v number or constant, e ...; $ line end, > and < around an indented block; b and u around a string with
# holes, y and z around a hole, m before its format. Keywords: d def, C class, I if, g elif, E else, F for, K while, t try, V except, U finally, h with,
# R return, T raise, f from, i import, Z del, G global nonlocal, H assert, Q pass break continue, L lambda, W yield, J await, Y async, N in, O not,
# S is, l and or, A as. Marks: w :=, a augmented, x *, X **, /, o other binary, | |, - signs, ~, c comparison, p @, r ->.
_PARAMETERS = """
pa% <- name{annotation} !'='
pd% <- name{annotation} '=' test
va% <- 'x' name{packed}
kw% <- 'X' name{annotation}
ko% <- name{annotation} ('=' test)?
tail% <- (va% (',' ko%)* / 'x' (',' ko%)+) (',' kw%)? / kw%
lead% <- pa% (',' pa%)* (',' '/' (',' pa%)*)? (',' pd%)* (',' '/' (',' pd%)*)? / pd% (',' pd%)* (',' '/' (',' pd%)*)?
params% <- ((lead% (',' tail%)? / tail%) ','?)?
"""
PYTHON = Grammar(
    """
name <- [n123]
hole <- 'y' yielded ('m' hole*)? 'z'
strings <- ('s' / 'b' hole* 'u')+ / 'B'+
paren <- '(' (yield / named clause+ / star ',' stars? / named / '') ')'
list <- '[' (named clause+ / stars)? ']'
entry <- 'X' arith / test ':' test
dict <- '{' (test ':' test clause+ / entry (',' entry)* ','? / named clause+ / stars)? '}'
atom <- name / [ve] / strings / paren / list / dict
slice <- test? ':' test? (':' test?)? / star
slices <- '[' slice (',' slice)* ','? ']'
passed <- 'x' test / named !'='
pair <- name '=' test
pairs <- (pair / 'x' test) (',' (pair / 'x' test))* (',' (pair / 'X' test))* / (pair / 'X' test) (',' (pair / 'X' test))*
args <- '(' (named clause+ / passed (',' passed)* (',' pairs)? ','? / pairs ','?)? ')'
access <- '.' name / slices
primary <- 'J'? atom (access / args)*
arith <- [-~]* primary ([-ox/p|X] [-~]* primary)*
boolean <- 'O'* [-~]* primary (([-ox/p|Xc] / 'l' 'O'* / 'O' 'N' / 'N' / 'S' 'O'?) [-~]* primary)*
lambda <- 'L' params_ ':' test
test <- lambda / boolean ('I' boolean 'E' test)?
named <- name 'w' test / test
star <- 'x' arith / named
stars <- star (',' star)* ','?
value <- 'x' arith / test
values <- value (',' value)* ','?
yield <- 'W' ('f' test / values)?
yielded <- yield / values
single <- atom (args* access)+ !'(' / name ![.(\\[] / '(' single ')' ![.(\\[]
target <- atom (args* access)+ !'(' / name ![.(\\[] / '(' targets? ')' ![.(\\[] / '[' targets? ']' ![.(\\[]
targets <- 'x'? target (',' 'x'? target)* ','?
gone <- target (',' target)* ','?
clause <- 'Y'? 'F' targets 'N' boolean ('I' boolean)*
dotted <- name ('.' name)*
alias <- name ('A' name)?
aliases <- alias (',' alias)*
import <- 'i' dotted ('A' name)? (',' dotted ('A' name)?)* / 'f' ([.e]* dotted / [.e]+) 'i' ('x' / '(' aliases ','? ')' / aliases)
assign <- (targets '=')+ yielded / single ('a' yielded / ':' test ('=' yielded)?) / yielded
typed <- '3' name typeparams? '=' test
small <- import / 'R' values? / 'T' (test ('f' test)?)? / 'Q' / 'Z' gone / 'G' name (',' name)* / 'H' test (',' test)? / typed / assign
simple <- small (';' small)* ';'? '$'
suite <- ':' ('$' '>' statement+ '<' / simple)
"""
    + _PARAMETERS.replace("%", "").format(annotation=" (':' test)?", packed=" (':' value)?")
    + _PARAMETERS.replace("%", "_").format(annotation="", packed="")
    + """
typeparam <- [xX]? name (':' test)? ('=' value)?
typeparams <- '[' typeparam (',' typeparam)* ','? ']'
function <- 'Y'? 'd' name typeparams? '(' params ')' ('r' test)? suite
class <- 'C' name typeparams? args? suite
branch <- 'I' named suite ('g' named suite)* ('E' suite)?
loop <- 'K' named suite ('E' suite)? / 'Y'? 'F' targets 'N' stars suite ('E' suite)?
try <- 't' suite (('V' 'x'? (test ('A' name)?)? suite)+ ('E' suite)? ('U' suite)? / 'U' suite)
item <- test ('A' 'x'? target)?
with <- 'Y'? 'h' ('(' item (',' item)* ','? ')' &':' / item (',' item)*) suite
literal <- '-'? 'v' ('-' 'v')? / strings
patterns <- pattern (',' pattern)* ','?
pattern <- closed ('|' closed)* ('A' name)?
closed <- literal / name ('.' name)* ('(' ((name '=')? pattern (',' (name '=')? pattern)* ','?)? ')')? / '(' patterns? ')' / '[' patterns? ']' / 'x' name / '{' (held (',' held)* ','?)? '}'
held <- 'X' name / (literal / name ('.' name)+) ':' pattern
match <- '1' stars ':' '$' '>' ('2' patterns ('I' named)? suite)+ '<'
statement <- ('p' named '$')* (function / class) / branch / loop / try / with / match / simple
file <- statement* eof
""",
    lines={"simple": "$"},
)

# n name, s string, J plain template, A B K parts of a template with holes, d number, r pattern. Keywords: F function, C class, V var let, O const, I if, E else,
# W while, D do, L for, R return, h throw, t try, H catch, Z finally, S switch, c case, f default, b break continue debugger, N new, u typeof
# delete, z void, w await, Y yield, i in instanceof, x extends, e export, m import, v this super null true false; words that may be names: y async, q of, T
# type, X is, 1 from, 2 as satisfies, 3 modifiers, 4 interface, 5 enum, 6 implements, 7 namespace module, 8 keyof infer unique asserts. Marks: > arrow, < and g
# angle brackets, - signs, ! ! and ~, k ++ --, a augmented, * *, M **, Q ??, l && and ||, & &, | |, o other binary, ~ spread, # private.
_SCRIPT = """
ident <- [nyqTX12345678]
word <- [nyqTX12345678FCVOIEWDLRhtHZScfbNuzwYixemv]
end <- ';' / &'}' / ^ / eof
init <- ('=' value)?
name <- '#'? word / [sd] / '[' value ']'
item <- '~'? binding init
held <- '~' binding / name ':' binding init / ident init
binding <- ident / '[' ','* (item (','+ item)* ','*)? ']' / '{' (held (',' held)* ','?)? '}'
params <- '(' (param (',' param)* ','?)? ')'
body <- '{' inner* '}'
function <- ('y' !^)? 'F' '*'? ident? generic params returns body
heritage <- ('x' operand targs)? implements
class <- decorator* 'C' (!'6' ident)? generic heritage '{' (';' / member)* '}'
decorator <- '@' ('(' expr ')' / ident ('.' word)* args?)
modified <- '3' &(name / '*' / 'y') / 'y' !^ &(name / '*')
member <- decorator* ('3' body / modified* '*'? name mark (generic params returns (body / bodyless) / annotation init end) / index)
property <- '~' value / modified* '*'? name generic params returns body / name ':' value / ident init
object <- '{' (property (',' property)* ','?)? '}'
array <- '[' ','* ('~'? value (','+ '~'? value)* ','*)? ']'
args <- '(' ('~'? value (',' '~'? value)* ','?)? ')'
template <- 'J' / 'A' expr ('B' expr)* 'K'
access <- '.' '#'? word / '[' expr ']'
callee <- 'N' callee args? / (function / class / '(' expr ')' / 'v' / 'm' '.' word / ident) access*
new <- 'N' ('.' word / callee targs args?)
primary <- function / class / new / template / 'm' ('.' word / &'(') / [dvsr] / '(' expr ')' / object / array / '#' ident / ident
call <- '?' '.' ('#'? word / args / '[' expr ']') / args / template / nonnull / typedcall
operand <- primary (access / call)*
place <- primary (call* access)+ / ident / object / array / '(' place ')'
arrowhead <- (generic params returns / ident) !^ '>'
plainhead <- (params / ident) !^ '>'
arrow <- ('y' !^ arrowhead / arrowhead) (body / value)
plain <- ('y' !^ plainhead / plainhead) (body / plainvalue) / conditional
bits <- [-!uzwk]* (assertion / operand (!^ 'k')? cast) (([-*i|&oM<] / 'g' 'g'? 'g'? '='?) [-!uzwk]* (assertion / operand (!^ 'k')? cast))*
conditional <- bits (('Q' bits)+ !'l' / ('l' bits)* !'Q') ('?' value ':' value / '?' plainvalue ':' value)?
yield <- 'Y' (!^ ('*' value / value))?
value <- yield / (&[(<y] / &(ident '>')) arrow / conditional ![=a] / place [=a] value
plainvalue <- yield / plain ![=a] / place [=a] value
expr <- value (',' value)*
declarator <- ident definite annotation init / binding annotation '=' value
constant <- binding annotation '=' value
declaration <- 'V' declarator (',' declarator)* / 'O' constant (',' constant)*
loophead <- [VO] binding annotation ('q' / 'i') expr / place ('q' / 'i') expr / (declaration / expr)? ';' expr? ';' expr?
named <- ('y' !^)? 'F' '*'? ident generic params returns (body / bodyless) / decorator* '3'* 'C' (!'6' ident) generic heritage '{' (';' / member)* '}'
source <- '1' 's' (!^ 'n' object)?
spec <- (word / 's') ('2' (word / 's'))? &[,}] / 'T' word ('2' word)?
specs <- '{' (spec (',' spec)* ','?)? '}'
imported <- ident (',' (specs / '*' '2' ident))? / specs / '*' '2' ident
import <- 'm' ('s' (!^ 'n' object)? end / imported source end / typeimport)
export <- decorator* 'e' ('f' (named / ('y' !^)? 'F' '*'? generic params returns body / interface / value end) / '*' ('2' (word / 's'))? source end / specs source? end / named / declaration end / typed / typeexport)
file <- (import / export / statement)* eof
"""
# inner: the statements of functions, where return is allowed
_STATEMENTS = """
block% <- '{' {s}* '}'
branch% <- 'I' '(' expr ')' {s} ('E' {s})?
loop% <- 'W' '(' expr ')' {s} / 'L' 'w'? '(' loophead ')' {s} / 'D' {s} 'W' '(' expr ')' ';'? / ident ':' {s}
try% <- 't' block% ('H' ('(' binding annotation ')')? block% ('Z' block%)? / 'Z' block%)
switch% <- 'S' '(' expr ')' '{' (('c' expr ':' / 'f' ':') {s}*)* '}'
{s} <- block% / ';' / branch% / loop% / try% / switch% / named / declaration end / typed / {returned}'h' !^ expr end / 'b' (!^ ident)? end / !([{FC] / 'y' !^ 'F') expr end
"""
_UNTYPED = """
generic <- ''
annotation <- ''
returns <- ''
implements <- ''
cast <- ''
mark <- ''
definite <- ''
targs <- ''
bodyless <- !any any
nonnull <- !any any
typedcall <- !any any
index <- !any any
interface <- !any any
typed <- !any any
typeimport <- !any any
typeexport <- !any any
assertion <- !any any
param <- '~'? binding init
"""
_TYPED = """
qualified <- ident ('.' word)*
typelist <- '<' type (',' type)* 'g'
targs <- typelist?
typeparam <- [3Oi]* ident ('x' type)? ('=' type)?
generic <- ('<' typeparam (',' typeparam)* ','? 'g')?
functype <- '3'? 'N'? generic params '>' (predicate / type)
predicate <- '8' (ident / 'v') ('X' type)? ![\\[.|&] / (ident / 'v') !^ 'X' type
tupleitem <- '~'? ident '?'? ':' type / '~'? type '?'?
mapped <- '{' ('-'? '3')? '[' ident 'i' type ('2' type)? ']' ('-'? '?')? (':' type)? ';'? '}'
signature <- '3'* '[' ident ':' type ']' annotation / ('3' &name)* name '?'? (generic params returns / annotation) / 'N'? generic params returns
members <- '{' (signature ([;,] / ^ / &'}'))* '}'
typebase <- functype / '8' typebase / '3' typebase / 'u' ('m' args ('.' word)* / ident ('.' '#'? word)* / 'v' ('.' '#'? word)*) targs / [vszdJ] / '-' 'd' / 'A' type ('B' type)* 'K' / 'm' args ('.' word)* targs / '[' (tupleitem (',' tupleitem)* ','?)? ']' / mapped / members / '(' type ')' / qualified (!^ targs)
typeunit <- typebase (!^ '[' type? ']')*
intersection <- '&'? typeunit ('&' typeunit)*
union <- '|'? intersection ('|' intersection)*
type <- union (!^ 'x' union '?' type ':' type)?
annotation <- (':' type)?
returns <- (':' (predicate / type))?
implements <- ('6' type (',' type)*)?
cast <- (!^ '2' ('O' / type))*
mark <- [?!]?
definite <- '!'?
bodyless <- end
nonnull <- !^ '!' !'='
typedcall <- typelist (args / template)
index <- ('3' &('3' / '['))* '[' ident ':' type ']' annotation end
assertion <- '<' type 'g' [-!uzwk]* operand (!^ 'k')? cast
param <- decorator* ('3' &(ident / [{\\[3]))* '~'? (binding / 'v') '?'? annotation init
interface <- '4' !^ ident generic ('x' type (',' type)*)? members
enumitem <- name init
enum <- 'O'? '5' !^ ident '{' (enumitem (',' enumitem)* ','?)? '}'
module <- '7' !^ (qualified / 's') (block / moduleblock / end) 
ambientblock <- '{' ('e'? ambient / import / export / statement)* '}'
moduleblock <- '{' (import / export / statement)* '}'
alias <- 'T' !^ ident generic '=' type end
ambient <- [VO] binding annotation (',' binding annotation)* end
typed <- interface / alias / enum / module / '3' !^ ('7' !^ (qualified / 's') (ambientblock / end) / 'n' ambientblock) / '3' !^ ('3' !^)* (ambient / named / declaration end / typed)
typeimport <- 'T' imported source end / 'T'? ident '=' (ident args / qualified) end
typeexport <- 'T' ('*' ('2' word)? source end / specs source? end) / '=' value end / '2' '7' ident end / '3'+ (class / named) / typeimported
typeimported <- 'm' ident '=' (ident args / qualified) end
"""


def _statements() -> str:
    plain = _STATEMENTS.replace("%", "").replace("{s}", "statement").replace("{returned}", "")
    return plain + _STATEMENTS.replace("%", "_").replace("{s}", "inner").replace("{returned}", "'R' (!^ expr)? end / ")


JAVASCRIPT = Grammar(_UNTYPED + _SCRIPT + _statements())
# hole: what may stand in a template of a type as well
TYPESCRIPT = Grammar(_TYPED + _SCRIPT + _statements())

# n name, s string, d number, ; end of a statement, written or implied. Keywords: F func, V var, c const, T type, i import, p package, I if, E else, L for, g
# range, S switch, W select, C case, f default, R return, b break continue goto fallthrough, G go defer, M map, h chan, r struct, j interface. Marks: w :=,
# a augmented, k ++ --, * *, & &, - signs, ! ! ^, | |, o other binary, > <-, e ..., ~.
# control: expressions in the head of a statement, where a brace behind a name begins the block
_GO_EXPR = """
operand% <- typelit braces / 'F' signature block / {named}typelit / [ds] / 'n' / '(' (expr / type) ')'
trailer% <- '.' ('n' / '(' ('T' / type) ')') / index / args
primary% <- operand% trailer%*
expr% <- [-!*&>]* primary% ([-o*&|!] [-!*&>]* primary%)*
exprs% <- expr% (',' expr%)*
simple% <- names 'w' exprs% / exprs% (('=' / 'a') exprs% / 'k' / '>' expr%)?
"""
GO = Grammar(
    """
end <- ';' / &[)}] / eof
qual <- 'n' ('.' 'n')?
names <- 'n' (',' 'n')*
targs <- '[' type (',' type)* ','? ']'
typelit <- '[' 'e' ']' type / '[' expr? ']' type / 'M' '[' type ']' type / '>'? 'h' '>'? type / 'F' signature / 'r' '{' (';' / field end)* '}' / 'j' '{' (';' / element end)* '}'
type <- '*' type / typelit / '(' type ')' / qual targs?
field <- names type 's'? / '*'? qual targs? 's'?
constraint <- '~'? type ('|' '~'? type)*
element <- 'n' signature / constraint
param <- 'n' 'e'? type / 'e'? type
params <- '(' (param (',' param)* ','?)? ')'
signature <- params (params / type)?
tparam <- names constraint
tparams <- '[' tparam (',' tparam)* ','? ']'
item <- expr / braces
pair <- item (':' item)?
braces <- '{' (pair (',' pair)* ','?)? '}'
index <- '[' (expr? ':' expr? (':' expr)? / (expr / type) (',' (expr / type))* ','?) ']'
args <- '(' ((expr / type) 'e'? (',' (expr / type) 'e'?)* ','?)? ')'
"""
    + _GO_EXPR.replace("%", "").replace("{named}", "qual targs? braces / ")
    + _GO_EXPR.replace("%", "_").replace("{named}", "")
    + """
statements <- (';' / statement end)*
block <- '{' statements '}'
branch <- 'I' (simple_? ';')? simple_ block ('E' (branch / block))?
range <- (exprs_ ('w' / '='))? 'g' expr_
loop <- 'L' (range / simple_? ';' simple_? ';' simple_? / simple_)? block
cases <- ('C' (expr / type) (',' (expr / type))* / 'f') ':' statements
switch <- 'S' (simple_? ';')? simple_? '{' cases* '}'
select <- 'W' '{' (('C' simple / 'f') ':' statements)* '}'
varspec <- names (type ('=' exprs)? / '=' exprs)
constspec <- names (type? '=' exprs)?
typespec <- 'n' tparams '='? type / 'n' '='? type
declared <- 'V' ('(' (';' / varspec end)* ')' / varspec) / 'c' ('(' (';' / constspec end)* ')' / constspec) / 'T' ('(' (';' / typespec end)* ')' / typespec)
statement <- 'n' ':' (statement / &';' / &'}') / branch / loop / switch / select / block / declared / 'R' exprs? / 'b' 'n'? / 'G' expr / simple
importspec <- ('n' / '.')? 's'
import <- 'i' ('(' (';' / importspec end)* ')' / importspec)
function <- 'F' params? 'n' tparams? signature block?
file <- ';'* 'p' 'n' end (';' / import end)* (';' / (function / declared) end)* eof
"""
)

# n name, s string, d number, v true false, l lifetime. Keywords: F fn, V let, c const static, T type, u use, m mod, S struct union, e enum, i impl, t trait, I if,
# E else, M match, W while, L for, N in, D loop, R return, b break continue, p pub, q unsafe async extern move, w where, a as, y mut ref, x dyn.
# Marks: 2 ::, > ->, < and g angle brackets, f =>, = =, + augmented, P plus, & && or &, * *, - -, ! !, ? ?, o other binary, | |, h ||, r range, # attribute, @ @.
# control: expressions in the head of a statement, where a brace behind a path begins the block
_RUST_EXPR = """
start% <- {let}macro / [dsv] / flow / closure% / jump% / {made}path / '(' (attr* expr (',' attr* expr)* ','?)? ')' / array
closure% <- 'q'* ('h' / '|' (slot (',' slot)* ','?)? '|') ('>' type block / expr%)
jump% <- 'R' expr%? / 'b' 'l'? expr%?
trailer% <- '.' ('n' ('2' targs)? / 'd') / '(' (attr* expr (',' attr* expr)* ','?)? ')' / '[' expr ']' / '?'
unary% <- ([-!*] / '&' 'y'?)* start% trailer%* ('a' typed)*
binary% <- unary% (([-o*&|hP<] / 'g' 'g'?) unary%)*
range% <- 'r' binary%? / binary% ('r' binary%?)?
expr% <- range% ([=+] expr%)?
"""
RUST = Grammar(
    """
attr <- '#' '[' tree* ']'
inner <- '#' '!' '[' tree* ']'
vis <- ('p' ('(' ('n' / 'N' path) ')')?)?
targ <- 'l' / 'n' targs? '=' type / 'n' ':' bounds / type / '-'? [dsv] / block
targs <- '<' (targ (',' targ)* ','?)? 'g'
types <- (type (',' type)* ','?)?
segment <- 'n' ('2'? targs / '(' types ')' ('>' typed)?)?
qualified <- '<' type ('a' typepath)? 'g' ('2' segment)+
typepath <- qualified / '2'? segment ('2' segment)*
forlife <- 'L' generic
bound <- 'l' / '?'? (forlife? typepath / '(' bound ')') / forlife
bounds <- (bound ('P' bound)* 'P'?)?
fntype <- forlife? [cq]* 's'? 'F' '(' (attr* ('n' ':')? (type / 'r') (',' attr* ('n' ':')? (type / 'r'))* ','?)? ')' ('>' typed)?
typed <- '!' / '*' ('c' / 'y') typed / '&' 'l'? 'y'? typed / '(' types ')' / '[' type (';' expr)? ']' / fntype / [xi] bounds / typepath ('!' delimited)?
type <- typed ('P' bound)*
gparam <- attr* ('l' (':' bounds)? / 'c' 'n' ':' type ('=' (block / '-'? [dsv] / 'n'))? / 'n' (':' bounds)? ('=' type)?)
generic <- ('<' (gparam (',' gparam)* ','?)? 'g')?
condition <- 'l' ':' bounds / forlife? type ':' bounds
where <- ('w' (condition (',' condition)* ','?)?)?
delimited <- '(' tree* ')' / '[' tree* ']' / '{' tree* '}'
path <- '<' type ('a' typepath)? 'g' ('2' ('n' / targs))+ / '2'? 'n' ('2' (targs / 'n'))*
macro <- path '!' 'n'? delimited
literal <- '-'? [dsv]
limit <- literal / path
fieldpat <- attr* ('r' / ('n' / 'd') ':' pattern / 'y'* 'n')
single <- '&' 'y'? single / 'y'+ 'n' ('@' single)? / 'n' '@' single / macro / limit 'r' limit? / literal / path ('(' (attr* pattern (',' attr* pattern)* ','?)? ')' / '{' (fieldpat (',' fieldpat)* ','?)? '}')? / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / 'r' limit?
pattern <- '|'? single ('|' single)*
slot <- attr* single (':' type)?
array <- '[' (attr* expr ';' expr / attr* expr (',' attr* expr)* ','?)? ']'
given <- attr* ('n' / 'd') (':' expr)? / 'r' expr?
struct <- path '{' (given (',' given)* ','?)? '}'
branch <- 'I' expr_ block ('E' (branch / block))?
arm <- attr* pattern ('I' expr_)? 'f' (block ![.?] ','? / expr (',' / &'}'))
match <- 'M' expr_ '{' inner* arm* '}'
loop <- ('l' ':')? ('W' expr_ block / 'L' pattern 'N' expr_ block / 'D' block / block)
flow <- branch / match / loop / ('q' / 'c')+ block
"""
    + _RUST_EXPR.replace("%", "").replace("{let}", "").replace("{made}", "struct / ")
    + _RUST_EXPR.replace("%", "_").replace("{let}", "'V' pattern '=' unary_ / ").replace("{made}", "")
    + """
let <- 'V' pattern (':' type)? ('=' expr ('E' block)?)? ';'
statement <- ';' / attr* let / item / attr* flow ![.?] / attr* path '!' '{' tree* '}' ![.?] / attr* expr (';' / &'}')
block <- '{' inner* statement* '}'
self <- '&' 'l'? 'y'? 'n' &[,)] / 'y'? 'n' &[,)]
argument <- attr* (pattern ':' (type / 'r') / self / type / 'r')
fn <- ('c' / 'q' 's'?)* 'F' 'n' generic '(' (argument (',' argument)* ','?)? ')' ('>' type)? where (';' / block)
used <- '2'? ('n' '2')* ('*' / '{' (used (',' used)* ','?)? '}' / 'n' ('a' 'n')?)
tuple <- '(' (attr* vis type (',' attr* vis type)* ','?)? ')'
fields <- '{' (attr* vis 'n' ':' type (',' attr* vis 'n' ':' type)* ','?)? '}'
variant <- attr* vis 'n' (tuple / fields)? ('=' expr)?
items <- '{' inner* item* '}'
kind <- 'u' used ';' / 'm' 'n' (';' / items) / 'S' 'n' generic (tuple where ';' / where fields / ';') / 'e' 'n' generic where '{' (variant (',' variant)* ','?)? '}' / 'q'* 'i' generic 'c'? '!'? type ('L' type)? where items / 'q'* 't' 'n' generic (':' bounds)? where items / 'T' 'n' generic (':' bounds)? where ('=' type)? where ';' / 'c' 'y'? 'n' ':' type ('=' expr)? ';' / 'q' 'n' 'n' ('a' 'n')? ';' / 'q'+ 's'? items
item <- attr* vis (fn / kind) / attr* path '!' 'n'? ('{' tree* '}' / delimited ';')
file <- inner* item* eof
"""
)
